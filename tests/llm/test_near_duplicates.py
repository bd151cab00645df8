import random

from newsloom.llm import near_duplicates as nd


def shingles(t):
    w = nd.words(t)
    return {*zip(w, w[1:], w[2:])}


def brute(rows, least=0.5):
    s = {i: shingles(t) for i, t in rows if t is not None and i is not None}
    s = {i: x for i, x in s.items() if x}
    ids = sorted(s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= least * len(s[a] | s[b])}


def corpus():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            if rng.random() < 0.3:
                t = t[20:] + t[:20]
            rows.append((n := n + 1, " ".join(t)))
    rows += [(9000, rows[0][1]), (9001, rows[0][1]), (9002, rows[0][1].upper() + "!!"), (9003, None), (9004, "a b"), (9005, ""), (9006, "a b"), (9007, "Ärger! mit_drei"), (9008, "ärger mit drei")]
    return rows


def test_pairs_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(*rows[5], "x")], "article_id long, text string, id string")
    got = {tuple(r) for r in nd.near_pairs(df).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.98 * len(want)
    assert {(9007, 9008), (9000, 9001), (1, 9000), (1, 9002)} <= got


def test_large_class_of_copies_is_a_star(spark):
    rows = [(k, "one two three four five six seven") for k in range(1, 81)] + [(500, "one two three four five six seven eight")]
    df = spark.createDataFrame(rows, "article_id long, text string")
    got = {tuple(r) for r in nd.near_pairs(df, expanded=10).collect()}
    assert got == {(1, k) for k in range(2, 81)} | {(1, 500)}
    assert {tuple(r) for r in nd.near_pairs(df, expanded=100).collect()} == brute(rows)


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "article_id long, text string")
    got = {r.article_id: r for r in nd.near_groups(df).collect()}
    assert set(got) == {i for i, t in rows if t is not None}
    links = {tuple(r) for r in nd.near_pairs(df).collect()}
    parent = {i: i for i in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    text = dict(rows)
    assert all(got[i].group_id == find(i) for i in got if shingles(text[i]))
    assert got[9001].class_id == 1 and got[9004].links == 0


def test_estimate_and_empty(spark):
    assert nd.near_pairs(spark.createDataFrame([], "article_id long, text string")).count() == 0
    rng = random.Random(2)
    a = [f"x{k}" for k in range(300)]
    b = a[:200] + [f"y{k}" for k in range(100)]
    _, r = nd.Sketcher().registers([" ".join(a), " ".join(b)])
    j = len(shingles(" ".join(a)) & shingles(" ".join(b))) / len(shingles(" ".join(a)) | shingles(" ".join(b)))
    assert abs((r[0] == r[1]).mean() - j) < 0.12
    rng.random()
    _, u = nd.Sketcher().registers([" ".join(a) + " " + " ".join(b)])
    _, parts = nd.Sketcher().registers([" ".join(a), " ".join(b)])
    assert (u[0] >= parts.max(axis=0)).all()
