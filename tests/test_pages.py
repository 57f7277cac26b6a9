"""The whole run over pages after the merge, against plain loops."""
import math
from collections import Counter, defaultdict

from veilframe.fixtures import view
from veilframe.operators import boxes as ops
from veilframe.operators import gate
from veilframe.plans import box_queries as Q


def test_redact_pages(spark, folder):
    merged = [r.asDict() for r in Q.merged_pages(spark, folder).collect()]
    history = defaultdict(list)
    name = lambda r: f"{r['label']}_{r['pattern']}" if r["pattern"] else r["label"]
    for r in view(spark, folder, "v_feedback").collect():
        if r.score is not None and r.user_feedback is not None:
            history[name(r)].append((r.ts, r.event_id, 1 - r.score if r.user_feedback else -r.score))
    for r in merged:
        known = history[name(r)]
        if len(known) > 10 and r["score"] is not None:
            last = [c for _, _, c in sorted(known, reverse=True)[:50]]
            r["score"] = max(0.0, min(1.0, r["score"] + 0.3 * sum(last) / len(last)))
    model = Q.page_gate(spark, folder).stages[-1]
    weights, base = list(model.coefficients), model.intercept
    sized = spark.createDataFrame(
        [(r["doc_id"], r["page_no"], r["det_no"], r["word"], r["x0"], r["y0"], r["x1"], r["y1"], r["label"], r["priority"], r["score"], 2550, 3300)
         for r in merged], "doc_id long, page_no int, det_no long, word string, x0 int, y0 int, x1 int, y1 int, label string, priority int, score double, page_w int, page_h int")
    kept, risk = {}, Counter()
    refused = 0
    for r in ops.features(sized).collect():
        chance = 1 / (1 + math.exp(-base - sum(w * r[f] for w, f in zip(weights, gate.INPUTS))))
        if chance > 0.5:
            kept[r.doc_id, r.page_no, r.word, r.label, r.priority, r.score and round(r.score, 6), round(chance, 6)] = r
            risk[r.doc_id, r.page_no] += r.priority
        else:
            refused += 1
    assert refused and kept  # the gate matters on this table
    got = Q.redact_pages(spark, folder).collect()
    seen = {(r.doc_id, r.page_no, r.word, r.label, r.priority, r.score and round(r.score, 6), round(r.gate, 6)) for r in got}
    assert seen <= set(kept)
    # What else is missing has no plausible box.
    plausible = {r.det_no for r in ops.instructions(sized, Q.F.lit(2)).collect()}
    assert {k for k, r in kept.items() if r.det_no in plausible} <= seen
    assert all(r.risk == risk[r.doc_id, r.page_no] for r in got)
