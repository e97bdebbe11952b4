"""Two self-contained HTML pages from bounded results: the pileup of each group, and its summary.

Everything that grows with the data is reduced in Spark first; what reaches the driver is limited per
group: ``max_rows`` rows, one number a position, ``TABLE_ROWS`` variants, ``WINDOWS`` windows.
"""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pilewright.functions.scales import label_color, nice_step
from pilewright.operators import features as annotations
from pilewright.operators import orderings, pileup, variants

TABLE_ROWS, WINDOWS, WINDOW_ROWS, WINDOW_COLUMNS, PROFILE_COLUMNS = 50, 6, 6, 60, 1000
#: The tier in which a consequence is shown.
TIERS = {"clean": "ok", "silent": "warn", "noncoding": "warn", "inframe_indel": "warn", "missense": "bad", "nonsense": "bad", "frameshift": "bad", "variant": "neutral"}
BASE_COLORS = {"A": "#4f9d5d", "C": "#3f6fb5", "G": "#c98b1f", "T": "#b8473d", "-": "#8a8a8a"}
STYLE = """
:root{color-scheme:light dark;--ink:#222;--paper:#fff;--line:#ccc}
@media (prefers-color-scheme:dark){:root{--ink:#ddd;--paper:#1b1b1b;--line:#444}}
body{font:14px system-ui,sans-serif;color:var(--ink);background:var(--paper);margin:1rem}
.mono,.pileup{font:12px ui-monospace,monospace;white-space:pre;overflow-x:auto}
.chip{padding:0 .5em;border-radius:.7em;border:1px solid var(--line)} .ok{background:#2e7d3233} .warn{background:#f9a82533} .bad{background:#c6282833}
table{border-collapse:collapse} td,th{padding:.1em .6em;border-bottom:1px solid var(--line);text-align:left}
svg{display:block;max-width:100%}
"""
SCRIPT = """
const data=JSON.parse(document.getElementById('pileups').textContent);
for(const g of data){const at=document.getElementById('g'+g.id);const lines=[g.ref,...g.rows];
at.textContent=lines.join('\\n');at.addEventListener('mousemove',e=>{const r=document.caretRangeFromPoint&&document.caretRangeFromPoint(e.clientX,e.clientY);
if(r){const n=r.startOffset%(g.ref.length+1);at.title=n<g.ref.length?'position '+(n+1)+': '+(g.frequency[n]*100).toFixed(1)+' % differ':''}})}
"""


@dataclass(frozen=True)
class View:
    """What a page is made of; nothing is computed before a page is rendered."""

    title: str
    rows: DataFrame
    groups: DataFrame
    features: DataFrame
    constructs: DataFrame
    order: str = "length"
    max_rows: int = 500
    min_fraction: float = 0.25
    min_count: int = 2


def script_json(value: object) -> str:
    """JSON that may stand inside a script element."""
    return json.dumps(value, ensure_ascii=False).replace("</", "<\\/").replace("<!--", "<\\!--")


def chip(status: str | None, tier: str | None) -> str:
    return f'<span class="chip {tier}">{html.escape(status or "")}</span>' if tier else ""


def page(title: str, body: str) -> str:
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>'


def track_svg(lanes: list[dict], ref_len: int, width: int = 1000) -> str:
    """Features in their lanes: start, end, lane, label, strand."""
    scale, out = width / max(ref_len, 1), []
    for f in lanes:
        fill = BASE_COLORS["ACGT"[f["lane"] % 4]]
        x, w, y = f["start"] * scale, max(1.0, (f["end"] - f["start"]) * scale), 4 + 18 * f["lane"]
        arrow = {1: " →", -1: " ←"}.get(f["strand"], "")
        out.append(f'<rect x="{x:.1f}" y="{y}" width="{w:.1f}" height="14" fill="{fill}"><title>{html.escape(str(f["label"]))}{arrow} · {f["start"] + 1}..{f["end"]}</title></rect>')
        if len(str(f["label"])) * 7 + 6 <= w:
            out.append(f'<text x="{x + 3:.1f}" y="{y + 11}" font-size="11" fill="{label_color(fill)}">{html.escape(str(f["label"]))}</text>')
    height = 26 + 18 * (max((f["lane"] for f in lanes), default=0) + 1)
    step = nice_step(ref_len)
    out += [f'<text x="{p * scale:.1f}" y="{height - 4}" font-size="10" fill="currentColor">{p}</text>' for p in range(step, ref_len, step)]
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}">{"".join(out)}</svg>'


def depth_svg(profile: list[int], ceiling: int, width: int = 1000, height: int = 48) -> str:
    if not profile or not ceiling:
        return ""
    points = " ".join(f"{width * i / len(profile):.1f},{height - height * min(1, d / ceiling):.1f}" for i, d in enumerate(profile))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polygon points="0,{height} {points} {width},{height}" fill="#3f6fb555"/></svg>'


def _drawn(view: View, placed: DataFrame) -> DataFrame:
    order = orderings.ORDERINGS[view.order](placed)
    return order.filter(F.col("place") <= view.max_rows).join(placed.select("row_id", "spec"), "row_id")


def render_pileup(view: View) -> str:
    """The rows of each group under its reference, with identity and how often each position differs."""
    placed = pileup.placed_rows(view.rows, view.groups)
    cells = pileup.cells_of(placed.filter(F.col("first").isNotNull()))
    stats = pileup.counted_positions(placed).drop("ref_base", "alts")
    rows = _drawn(view, placed).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", F.upper("spec").alias("spec")))).alias("rows"))
    off = pileup.mismatch_counts(stats, view.groups).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.round("fraction", 4).alias("f")))).alias("off"))
    identity = pileup.flag_identity(cells)
    tier = view.groups.select("group_id", "group_ord", "name", "ref_seq", "n_reads", "status", variants.status_tier(F.col("status"), F.col("highlighted")).alias("tier"))
    found = tier.join(rows, "group_id", "left").join(off, "group_id", "left").join(identity, "group_id", "left").orderBy("group_ord", "group_id").collect()
    parts, data = [], []
    for g in found:
        same = "" if g["identity"] is None else f" · identity {g['identity']:.1%}"
        parts.append(f'<h2>{html.escape(g["name"] or "")} {chip(g["status"], g["tier"])}</h2><p>{g["n_reads"] or 0} reads{same}</p><div class="pileup" id="g{g["group_id"]}"></div>')
        data.append({"id": g["group_id"], "ref": (g["ref_seq"] or "").upper(), "rows": [r["spec"] for r in g["rows"] or []], "frequency": [o["f"] for o in g["off"] or []]})
    return page(view.title, "".join(parts) + f'<script type="application/json" id="pileups">{script_json(data)}</script><script>{SCRIPT}</script>')


def summary_tables(view: View) -> dict[str, list]:
    """The bounded tables of the summary page."""
    placed = pileup.placed_rows(view.rows, view.groups)
    cells = pileup.cells_of(placed.filter(F.col("first").isNotNull()))
    counted = pileup.counted_positions(placed)
    stats = counted.drop("ref_base", "alts")
    floors = {"min_fraction": view.min_fraction, "min_count": view.min_count}
    called = variants.call_snvs(counted, **floors).unionByName(variants.call_deletions(counted, pileup.deletion_runs(placed), view.groups, **floors))
    judged = variants.describe(variants.classify(called, annotations.reading_frames(view.features, view.groups)))
    top = variants.variant_table(judged, TABLE_ROWS)
    windows = orderings.variant_windows(top, view.groups, WINDOWS, WINDOW_COLUMNS)
    shown = orderings.interesting_first(placed, windows, WINDOW_ROWS).join(windows.select(F.col("group_id").alias("g"), F.col("window_no").alias("w"), "start", "end"), (F.col("group_id") == F.col("g")) & (F.col("window_no") == F.col("w")))
    texts = shown.join(placed.select(F.col("row_id").alias("r"), "spec"), F.col("row_id") == F.col("r"))
    texts = texts.select("group_id", "window_no", "place", "start", "end", F.substring(F.upper("spec"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    track = annotations.track_plan(annotations.kept_features(view.features), view.constructs).join(annotations.feature_spans(view.features, view.constructs).drop("construct_id"), "feature_id")
    named = view.features.select(F.col("feature_id").alias("f"), F.coalesce("label", "type").alias("label"), "strand")
    return {
        "groups": view.groups.select("group_id", "construct_id", "group_ord", "name", "n_reads", "ref_seq").join(variants.verdicts(judged, view.groups), "group_id").join(pileup.group_summary(stats, view.groups), "group_id").orderBy("group_ord", "group_id").collect(),
        "variants": top.orderBy("group_id", "rank_no").collect(),
        "depth": pileup.depth_profile(stats, view.groups, PROFILE_COLUMNS).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "depth"))).alias("profile")).collect(),
        "windows": texts.orderBy("group_id", "window_no", "place").collect(),
        "track": track.join(named, F.col("feature_id") == F.col("f")).filter(F.col("lane") >= 0).select("construct_id", "start", "end", "lane", "label", "strand").collect(),
    }


def render_summary(view: View) -> str:
    """Per group: verdict, coverage, annotation track, depth, variants, and windows of the worst ones."""
    t = summary_tables(view)
    by = lambda name, key="group_id": {k: [r for r in t[name] if r[key] == k] for k in {r[key] for r in t[name]}}
    called, depth, windows, track = by("variants"), by("depth"), by("windows"), by("track", "construct_id")
    ceiling = max((g["max_depth"] for g in t["groups"]), default=0)
    parts = []
    for g in t["groups"]:
        share = g["covered"] / g["ref_len"] if g["ref_len"] else 0
        same = "" if g["identity"] is None else f" · identity {g['identity']:.1%}"
        parts.append(f'<h2>{html.escape(g["name"] or "")} {chip(g["verdict"], TIERS.get(g["verdict"], "neutral"))}</h2><p>{g["n_reads"] or 0} reads · mean depth {g["mean_depth"]:.1f} · {share:.0%} covered{same}</p>')
        parts.append(track_svg([r.asDict() for r in track.get(g["construct_id"], [])], max([g["ref_len"], *(r["end"] for r in track.get(g["construct_id"], []))])))
        parts.append(depth_svg([p["depth"] for r in depth.get(g["group_id"], []) for p in r["profile"]], ceiling))
        rows = called.get(g["group_id"], [])
        if rows:
            cells = "".join(f'<tr><td>{v["pos"] + 1}</td><td>{html.escape(v["label"])}</td><td>{v["count"]}/{v["depth"]}</td><td>{v["fraction"]:.0%}</td><td>{html.escape(v["consequence"])}</td><td>{html.escape(v["effect"])}</td></tr>' for v in rows)
            more = f"<p>{rows[0]['of'] - len(rows)} more</p>" if rows[0]["of"] > len(rows) else ""
            parts.append(f"<table><tr><th>position</th><th>change</th><th>reads</th><th>share</th><th>consequence</th><th>effect</th></tr>{cells}</table>{more}")
        for number in sorted({w["window_no"] for w in windows.get(g["group_id"], [])}):
            own = [w for w in windows[g["group_id"]] if w["window_no"] == number]
            ref = (g["ref_seq"] or "").upper()[own[0]["start"] : own[0]["end"]]
            parts.append(f'<p>{own[0]["start"] + 1}..{own[0]["end"]}</p><div class="mono">{html.escape(chr(10).join([ref, *(w["text"] for w in own)]))}</div>')
    return page(f"{view.title}: summary", "".join(parts))


def limited_to(view: View, construct_id: int) -> View:
    """The view of one construct."""
    groups = view.groups.filter(F.col("construct_id") == construct_id)
    rows = view.rows.join(groups.select("group_id"), "group_id", "left_semi")
    return View(view.title, rows, groups, view.features.filter(F.col("construct_id") == construct_id), view.constructs.filter(F.col("construct_id") == construct_id), view.order, view.max_rows, view.min_fraction, view.min_count)


def drawn_counts(view: View) -> DataFrame:
    """group_id, drawn, hidden: how many rows a page shows of each group."""
    placed = pileup.placed_rows(view.rows, view.groups)
    n = Window.partitionBy("group_id")
    return placed.withColumn("n", F.count(F.lit(1)).over(n)).groupBy("group_id").agg(F.least(F.first("n"), F.lit(view.max_rows).cast("bigint")).alias("drawn"), F.greatest(F.first("n") - view.max_rows, F.lit(0).cast("bigint")).alias("hidden"))
