"""Where results go: appended answers, statistics, leaderboards, weights, a self-contained graph page."""

from __future__ import annotations

import html
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV = dict(header=True, quote='"', escape='"', quoteAll=True)


def usable(col: str = "output_triplets"):
    """Not null, blank or the text nan."""
    t = F.lower(F.trim(F.col(col)))
    return F.col(col).isNotNull() & (t != "") & (t != "nan")


def append_answers(df: DataFrame, path: str, col: str = "output_triplets") -> None:
    """Usable answers appended in one commit; re-runs skip them by title (``articles.not_done``)."""
    df.filter(usable(col)).write.mode("append").options(**CSV).csv(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def judgements(df: DataFrame, path: str) -> None:
    """Rows without any null."""
    overwrite(df.dropna("any"), path)


def weights(df: DataFrame, path: str) -> None:
    """Best states per model and period, partitioned by model."""
    df.select("model", "period", "weights").write.mode("overwrite").partitionBy("model").parquet(path)


def output_name(model: str, data: str, column: str, suffix: str = "") -> str:
    return f"triplets_{model}_{data}_{column}{suffix}.csv"


def stage_name(path: str, stage: str) -> str:
    """The name of a stage's output beside its input, e.g. metrics_computation or judgments_evaluation."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}_JudgeLLM_{stage}{p.suffix}"))


PAGE = """<!doctype html><meta charset="utf-8"><title>%s</title><style>body{margin:0;font:13px sans-serif}svg{width:100vw;height:100vh}line{stroke:#999}text{pointer-events:none}</style><svg id="s"></svg><script>
const g=%s,s=document.getElementById("s"),W=innerWidth,H=innerHeight,ns="http://www.w3.org/2000/svg",el=(t,a,x)=>{const e=document.createElementNS(ns,t);for(const k in a)e.setAttribute(k,a[k]);if(x)e.textContent=x;s.appendChild(e);return e};
const types=[...new Set(g.nodes.map(n=>n.type))],at={};g.nodes.forEach((n,i)=>{const a=2*Math.PI*i/g.nodes.length;n.x=W/2+W*.35*Math.cos(a);n.y=H/2+H*.4*Math.sin(a);at[n.id]=n});
for(let r=0;r<200;r++){for(const e of g.edges){const a=at[e.source],b=at[e.target],dx=b.x-a.x,dy=b.y-a.y,d=Math.hypot(dx,dy)||1,f=(d-120)/d*.02;a.x+=dx*f;a.y+=dy*f;b.x-=dx*f;b.y-=dy*f}}
for(const e of g.edges){const l=el("line",{x1:at[e.source].x,y1:at[e.source].y,x2:at[e.target].x,y2:at[e.target].y});const t=document.createElementNS(ns,"title");t.textContent=e.label+(e.score==null?"":" "+e.score);l.appendChild(t)}
for(const n of g.nodes){el("circle",{cx:n.x,cy:n.y,r:6,fill:`hsl(${360*types.indexOf(n.type)/types.length},60%%,55%%)`});el("text",{x:n.x+8,y:n.y+4},n.id)}
</script>"""


def graph_page(nodes: DataFrame, edges: DataFrame, title: str = "graph", most: int = 2000) -> str:
    """One period's graph as a page of its own: id and type of nodes; source, target, label and score of edges.

    A page is for looking at: it takes the ``most`` edges of the highest score (or weight), which is its purpose.
    """
    rank = F.desc("score") if "score" in edges.columns else F.desc("w") if "w" in edges.columns else F.asc("source")
    rows = [r.asDict() for r in edges.orderBy(rank, "source", "target").limit(most).collect()]
    ends = {x for r in rows for x in (r["source"], r["target"])}
    named = nodes.join(F.broadcast(edges.sparkSession.createDataFrame([(x,) for x in ends], "id string")), "id", "left_semi").collect() if ends else []
    types = {r["id"]: r["type"] for r in named}
    data = {"nodes": [{"id": x, "type": types.get(x, "UNK")} for x in sorted(ends)], "edges": [{k: r.get(k) for k in ("source", "target", "label", "score")} for r in rows]}
    return PAGE % (html.escape(title), json.dumps(data, default=str).replace("</", "<\\/"))


def monthly_pages(nodes: DataFrame, edges: DataFrame, most: int = 2000) -> dict[str, str]:
    """A page per period of ``edges`` (by their column time)."""
    periods = [r[0] for r in edges.select("time").distinct().orderBy("time").collect()]
    return {p: graph_page(nodes, edges.filter(F.col("time") == p), p, most) for p in periods}
