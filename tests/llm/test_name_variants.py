from newsloom.llm import name_variants as nv

ENTITIES = [
    (1, "Braygyde Pacific Packaging", "COMPANY", "BYYYZ"), (2, "Kestrune Devices", "COMPANY", None), (3, "Kestrune Securities", "FINANCIAL_ENTITY", None), (4, "Sarnmarq Semiconductor", "COMPANY", None),
    (5, "Victoria Marduansky", "PERSON", None), (6, "Thomas Daskower", "PERSON", None), (7, "Tina Daskower", "PERSON", None), (8, "Lumstrov Asset Management", "FINANCIAL_ENTITY", None), (None, "Nobody", "PERSON", None), (9, None, "COMPANY", None),
]
CASES = {
    " Braygyde Pacific Packaging": 1, "BRAYGYDE": 1, "BPPC": 1, "BraygydePacificPackaging": 1, "Brayggyde": 1, "Packaging, Braygyde Pacific": 1, "The Braygyde Pacific Packaging Company": 1, "Braygyde Pacific Pkg, Ltd.": 1,
    "Kestrune Devs": 2, "Kestrune": None, "Kestrune Foods": None, "Kestrune Securities Inc": 3, "Sarnmarq S/C": 4, "Sarnmraq Semicon": 4, "Sarnmarq Hospitals Inc": None, "Lumstrov AM": 8, "Lumstrov Asset Mgmt Group": 8,
    "Vicky R. Marduansky": 5, "Marduansky, V.": 5, "Dr. Marduansky": 5, "V Marduanskky": 5, "MARDUANSKY, Victoria": 5, "T. Daskower": None, "Tom Daskower": 6, "Daskower, Tina": 7, "Revenue": None, "BYYYZ": None, "Kestrune Devices": None, "": None, "  ": None, "x" * 5000: None,
}


def test_variants(spark):
    e = spark.createDataFrame(ENTITIES, "entity_id long, entity_name string, entity_type string, ticker string")
    names = list(CASES)
    rows = [(k, n, "Revenue", "y") for k, n in enumerate(names)] + [(0, names[0], "Revenue", "y"), (900, None, "BPPC", "y"), (901, "BPPC", "BPPC", "y")]
    edges = spark.createDataFrame(rows, "edge_id long, sub string, obj string, side string")
    got = {(r.edge_id, r.side): r.entity_id for r in nv.linked_variants(edges, e).collect()}
    assert nv.linked_variants(edges, e).count() == len(got)
    wrong = {n: got.get((k, "sub")) for k, n in enumerate(names) if got.get((k, "sub")) != CASES[n]}
    assert wrong == {}
    assert got[900, "obj"] == 1 and got[901, "sub"] == got[901, "obj"] == 1
    assert nv.linked_variants(edges.limit(0), e).count() == 0 and nv.linked_variants(edges, e.limit(0)).count() == 0


def test_join_on_keys_agrees_with_the_index(spark, monkeypatch):
    e = spark.createDataFrame(ENTITIES, "entity_id long, entity_name string, entity_type string, ticker string")
    edges = spark.createDataFrame([(k, n, None) for k, n in enumerate(CASES)], "edge_id long, sub string, obj string")
    held = {tuple(r)[:2] for r in nv.variant_map(edges, e).collect()}
    monkeypatch.setattr(nv, "INDEXED_NAMES", 0)
    met = {tuple(r)[:2] for r in nv.variant_map(edges, e).collect()}
    assert held == met


def test_join_on_keys_knows_the_words_of_all_names(spark, monkeypatch):
    """Words of other names, equal costs and posteriors: to the last digit as by the index."""
    names = [(1, "Carlton Devices", "COMPANY", None), (2, "Charlton Foods", "COMPANY", None), (3, "Marston Group", "COMPANY", None), (4, "Marston Group", "COMPANY", None), (5, "Harston Anna", "PERSON", None), (6, "Marsten Devices", "COMPANY", None), (7, "Anna Harsten", "PERSON", None)]
    said = ["Charlton Devices", "Charlton", "Carlton Foods", "Chalrton Foods", "Marston", "Marstom Group", "Marsten Group", "Marsten", "Anna Harston", "A Harstten", "Carltan Devices", "MG", "Devices Charlton"]
    e = spark.createDataFrame(names, "entity_id long, entity_name string, entity_type string, ticker string")
    edges = spark.createDataFrame([(k, n, None) for k, n in enumerate([*said, "Marston Group", "Carlton Devices"])], "edge_id long, sub string, obj string")
    held = sorted(tuple(r) for r in nv.variant_map(edges, e).collect())
    monkeypatch.setattr(nv, "INDEXED_NAMES", 0)
    assert held and sorted(tuple(r) for r in nv.variant_map(edges, e).collect()) == held


def test_distance():
    def slow(a, b):
        d = {(-1, -1): 0}
        la, lb = len(a), len(b)
        d = [[0] * (lb + 1) for _ in range(la + 1)]
        for i in range(la + 1):
            for j in range(lb + 1):
                if not i or not j:
                    d[i][j] = i + j
                    continue
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[la][lb]

    import random

    rng = random.Random(4)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(2))
        assert nv.distance(a, b, 2) == min(3, slow(a, b))
