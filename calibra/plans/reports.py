"""Nested results of the studies as JSON and as Markdown."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from calibra.operators import rules as R
from calibra.sources import datasets as D


def as_json(result: dict) -> str:
    """JSON with two spaces; numbers that JSON lacks are null."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    return json.dumps(plain(result), indent=2, ensure_ascii=False) + "\n"


def number(v: float | None, digits: int = 3) -> str:
    return "-" if v is None or not math.isfinite(v) else f"{v:.{digits}f}"


def share(v: float | None) -> str:
    return "-" if v is None else f"{100 * v:.1f} %"


def interval(pair: Iterable[float], show: Callable[[float], str] = number) -> str:
    low, high = pair
    return f"{show(low)} to {show(high)}"


def table(head: list[str], rows: Iterable[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]


def frame_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    show = lambda v: "" if v is None else number(v, 4) if isinstance(v, float) else str(v)
    return "\n".join(table(df.columns, ([show(v) for v in r] for r in df.collect())))


def evaluation(r: dict) -> str:
    lines = [f"Overlap from {r['iou_threshold']}, confidence from {r['confidence_threshold']}, chosen on validation (micro F1 {number(r['val_micro_f1_at_threshold'])}).", ""]
    for part in ("val", "test"):
        p = r[part]
        lines += [f"### {part}", "", f"Micro F1 {number(p['micro_f1'])}, mean AP {number(p['map50_recomputed'])}, predictions on the background: {p['background_predictions']}.", ""]
        rows = []
        for c, e in p["errors"].items():
            partner = f"{e['partner_class']}: {e['partner']}" if e["partner_class"] else "-"
            own = f"{share(e['partner_share'])} ({interval(e['partner_ci95'], share)})" if e["partner_class"] else "-"
            scores = p["per_class"][c]
            rows.append([c, e["n_gt"], e["correct"], partner, e["other"], e["missed"], own, number(scores["precision"]), number(scores["recall"])])
        lines += table(["class", "boxes", "correct", "as partner", "as other", "missed", "partner's share (95 %)", "precision", "recall"], rows)
    return "\n".join([*lines, f"**Verdict: {r['verdict']}**", "", *(f"- {x}" for x in r["verdict_reasons"])])


def backdrop(r: dict) -> str:
    spread = lambda d: f"{number(d['median'], 1)} ({number(d['q1'], 1)} to {number(d['q3'], 1)})" if d.get("n") else "-"
    rows = [[g, r["measurable_boxes"][g], r["images"][g], r["unmeasurable_boxes"][g], spread(r["ring_b"][g]), spread(r["plate_chroma_secondary"][g])] for g in r["ring_b"]]
    w = r["within_image"]
    return "\n".join([
        f"{r['n_target_boxes']} test boxes of {r['target']}, confidence from {r['confidence_threshold']}.", "",
        *table(["group", "measured boxes", "images", "not measurable", "ring b* (quartiles)", "plate chroma (quartiles)"], rows),
        f"AUC of ring b*, misread above correct: **{number(r['auc_misread_vs_correct'])}**, 95 % {interval(r['auc_ci95_cluster_bootstrap'])} over {r['bootstrap_reps']} resamples of images (seed {r['bootstrap_seed']}, {r['bootstrap_skipped']} without a side).",
        f"Within images: {w['images_with_both']} with both groups, {w['pairs']} pairs, AUC {number(w['auc'])}.", "",
        f"**Verdict: {r['verdict']}**",
    ])


def recolouring(r: dict) -> str:
    g, t = r["baseline_gate"], r["target_colours"]
    lines = [f"Baseline: {g['n_checked']} boxes met again, {g['n_dropped']} otherwise ({'held' if g['passed'] else 'FAILED'}, {R.MOST_MISMATCHES} at most)."]
    lines += [f"Otherwise: {', '.join(g['dropped_images'])}."] if g["dropped_images"] else []
    if r["arms"]:
        ab = lambda s: f"({number(t[s][0], 1)}, {number(t[s][1], 1)}) of {t[f'n_{s}']} boxes"
        rows = [[arm, a["n"], a["successes"], share(a["share"]), interval(a["ci95"], share), number(a["median_target_confidence_change"]), share(a["clipped_pixels_median"])] for arm, a in r["arms"].items()]
        lines += [f"Colours (a*, b*): blue {ab('blue')}, yellow {ab('yellow')}.", "", *table(["arm", "boxes", "successes", "share", "95 %", "median change of confidence", "median clipped"], rows)]
    return "\n".join([*lines, f"**Verdict: {r['verdict']}**"])


def compared_runs(r: dict) -> str:
    p, g, runs = r["primary"], r["guardrails"], r["runs"]
    lines = [f"**Verdict: {r['verdict']}**: {r['consequence']}", "", *(f"- invalid: {x}" for x in r["invalid_reasons"]), ""]
    kinds = list(runs["run1"]["counts"])
    lines += table(["run", "threshold", *kinds], ([k, number(v["threshold"], 2), *v["counts"].values()] for k, v in runs.items()))
    lines += [f"Paired: {p['mcnemar_b_misread_by_2C_only']} boxes misread by 2C only, {p['mcnemar_c_misread_by_2A_only']} by 2A only, one-sided p {number(p['p_one_sided'], 4)}.", ""]
    lines += table(["criterion", "holds"], ([k, v] for k, v in p["criteria"].items()))
    rules = [["test mAP 50-95", g["G1"]], ["validation mAP 50-95, best", g["G2"]], *([f"test AP {c}", v | {"margin": g["G3"]["margin"]}] for c, v in g["G3"]["classes"].items())]
    lines += table(["guardrail", "2C", "2A", "margin", "holds"], ([n, number(v["2C"]), number(v["2A"]), v["margin"], v["ok"]] for n, v in rules))
    misread, target = kinds[1], kinds[0]
    sides = lambda v: [v["by_side"][s][k] for s in ("yellow", "blue") for k in (misread, target)]
    scores = ("test_map_50", "test_map_50_95", "val_map_50_95", "val_to_test_gap_map_50_95")
    lines += table(["run", *(f"{s} as {k}" for s in ("yellow", "blue") for k in (misread, target)), f"precision {misread}", *scores], ([k, *sides(v), number(v[f"precision_{misread}"]), *(number(v["metrics"][m]) for m in scores)] for k, v in runs.items()))
    return "\n".join(lines)


def deliver(spark: SparkSession, result: dict, text: str, path: str) -> None:
    """<path>.json and <path>.md; the text is also printed."""
    D.write_text(spark, f"{path}.json", as_json(result))
    D.write_text(spark, f"{path}.md", text + "\n")
    print(text)
