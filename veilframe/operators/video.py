"""Video detections: filters, votes, tracks, identity, policy and risk."""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import geometry as G
from veilframe.functions import tracking
from veilframe.functions.greedy import dropped_rows
from veilframe.functions.scan import bands, bind, dealt, ordered_fold
from veilframe.session import checkpoint

FRAME = ["video_id", "frame_no"]
BOX = ("x1", "y1", "x2", "y2")


def clip(dets: DataFrame, width: int, height: int) -> DataFrame:
    """Clip boxes to the frame, drop what lies outside."""
    inside = G.clipped_box(*[F.col(c) for c in BOX], F.lit(width), F.lit(height))
    rest = [c for c in dets.columns if c not in BOX]
    return bind(dets, _b=inside).where("_b IS NOT NULL").select(
        *rest, F.col("_b.x0").alias("x1"), F.col("_b.y0").alias("y1"), F.col("_b.x1").alias("x2"), F.col("_b.y1").alias("y2"))


def faces(dets: DataFrame) -> DataFrame:
    """Faces that are sure and large enough."""
    return dets.where((F.col("score") >= C.FACE_MIN_SCORE) & (F.col("x2") - F.col("x1") >= C.FACE_MIN_SIDE)
                      & (F.col("y2") - F.col("y1") >= C.FACE_MIN_SIDE))


def vehicles(dets: DataFrame, kind: str = "cls") -> DataFrame:
    return dets.where(F.col(kind).isin(C.VEHICLE_CLASSES) & (F.col("score") > C.VEHICLE_MIN_SCORE))


def plate_regions(dets: DataFrame) -> DataFrame:
    """The lower middle of a vehicle box, where its plate is expected."""
    side = ((F.col("x2") - F.col("x1")) * C.PLATE_SIDE_SHARE).cast("int")
    high = ((F.col("y2") - F.col("y1")) * C.PLATE_HEIGHT_SHARE).cast("int")
    return dets.select(*[c for c in dets.columns if c not in BOX], (F.col("x1") + side).alias("x1"),
                       (F.col("y2") - high).alias("y1"), (F.col("x2") - side).alias("x2"), "y2")


def detection_frames(dets: DataFrame) -> DataFrame:
    return dets.where(F.col("frame_no") % C.DETECTION_INTERVAL == 0)


def carry_text(dets: DataFrame, last_frame: DataFrame | None = None) -> DataFrame:
    """Repeat text boxes on the frames up to the next detection frame."""
    ahead = F.explode(F.sequence(F.col("frame_no"), F.col("frame_no") + (C.DETECTION_INTERVAL - 1)))
    out = detection_frames(dets).withColumn("shown", ahead)
    if last_frame is not None:
        out = out.join(dealt(last_frame.select("video_id", "last_frame")), "video_id").where("shown <= last_frame").drop("last_frame")
    return out


def vote(dets: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Join overlapping boxes of one frame into the mean box of their group.

    In row order, the first free box leads and takes every free box that
    overlaps it by more than half. Leaders are the greedy choice over those
    overlaps; everyone else belongs to the earliest leader it overlaps. Equal
    boxes are counted once with a weight.
    """
    x = [F.col(c) for c in BOX]
    solid = (x[2] > x[0]) & (x[3] > x[1])
    # Read several times below, so it is written once.
    firsts = checkpoint(dets.where(solid).groupBy(*keys, *BOX).agg(F.min("det_id").alias("det_id"), F.count("*").alias("weight")))
    pairs = G.similar_pairs(firsts.drop("weight"), keys, C.VOTE_IOU, BOX).where("a_det_id < b_det_id")
    near = checkpoint(pairs.select(*keys, "a_det_id", "b_det_id"))
    ident = [F.struct(*keys, F.col(f"{p}_det_id").alias("det_id")) for p in ("a", "b")]
    lost = dropped_rows(near.select(ident[0].alias("lo"), ident[1].alias("hi"))).select("id.*")
    leads = near.select(*keys, F.col("a_det_id").alias("leader"), F.col("b_det_id").alias("det_id")).join(
        dealt(lost.select(*keys, F.col("det_id").alias("leader"))), [*keys, "leader"], "left_anti")
    joins = leads.groupBy(*keys, "det_id").agg(F.min("leader").alias("leader"))
    members = firsts.join(dealt(joins), [*keys, "det_id"], "left").withColumn("leader", F.coalesce("leader", "det_id"))
    groups = members.groupBy(*keys, F.col("leader").alias("det_id")).agg(
        F.sum("weight").alias("votes"), *[(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).cast("int").alias(c) for c in BOX])
    # A box without area overlaps nothing, so it stands alone.
    alone = dets.where(~solid).select(*keys, "det_id", F.lit(1).cast("bigint").alias("votes"), *BOX)
    return groups.unionByName(alone).where(F.col("votes") >= least)


#: Detection frames to a segment of a video, and those before it that a guess starts from.
TRACK_SEGMENT, TRACK_WARM_UP, TRACK_ROUNDS = 2000, 64, 3
_PIECE = ["video_id", "stretch", "seg"]
_FOLDED = ("kind string, video_id bigint, stretch int, seg bigint, frame_no int, track_id bigint, x1 int, y1 int, x2 int, y2 int, type string, "
           "authorised boolean, live string, ids string, fresh bigint")


def _fold_segments(rows: DataFrame) -> DataFrame:
    """Track each segment on its own: box rows, and the live tracks at its start and end.

    A segment begins with the live tracks of its first row (``live``) or, without any,
    with those that its warm-up rows leave. They have the numbers -1, -2 .. in order and
    are not authorised; tracks begun inside count from 1. Live tracks are compared by
    their boxes, speeds, ages and types, in order, which is all that matching sees.
    """
    def begin() -> dict:
        return {"tracks": [], "next": 1, "found": [], "at": None, "warm": True, "out": []}

    def shown(state: dict, kind: str) -> tuple:
        at = state["at"]
        return (kind, *at[:3], None, None, None, None, None, None, None, None, json.dumps([t[1:11] for t in state["tracks"]]),
                json.dumps([[t[0], t[11]] for t in state["tracks"]]), state["next"] - 1)

    def settle(state: dict) -> list:
        """Update with the collected frame, then predict up to the next one."""
        if not state["found"]:
            return []
        video, stretch, seg, frame, last_frame, warm = state["at"]
        state["tracks"], state["next"] = tracking.update(state["tracks"], state["found"], state["next"])
        state["found"], out = [], []
        for ahead in range(frame, min(frame + C.DETECTION_INTERVAL, last_frame + 1)):
            if ahead > frame:
                tracking.predict(state["tracks"])
            if not warm:
                out += [("box", video, stretch, seg, ahead, t[0], *[int(v) for v in t[1:5]], t[10], t[11], None, None, None) for t in state["tracks"]]
        return out

    def step(state: dict, row: tuple) -> tuple[dict, list]:
        at = (row.video_id, row.stretch, row.seg, row.frame_no, row.last_frame, row.warm)
        if row.live is not None:
            state["tracks"] = [[0, *t, False] for t in json.loads(row.live)]
            return state, []
        out = settle(state) if at != state["at"] else []
        state["at"] = at
        if state["warm"] and not row.warm:
            state["warm"], state["next"] = False, 1
            for i, t in enumerate(state["tracks"]):
                t[0], t[11] = -1 - i, False
            out.append(shown(state, "start"))
        state["found"].append((row.x1, row.y1, row.x2, row.y2, row.type, row.is_auth))
        return state, out

    def finish(state: dict) -> list:
        return settle(state) + ([shown(state, "end")] if not state["warm"] else [])

    return ordered_fold(rows, _PIECE, [F.col("frame_no"), F.col("det_id")], begin, step, finish, _FOLDED)


def _stitched(rows: DataFrame) -> DataFrame:
    """Box rows of all segments as if each had begun where the one before ended.

    Segments whose guessed start differs from the end before them are tracked again from
    that end, all at once, until no seam differs. A stretch that still has wrong seams
    after a few rounds is tracked in one go from the first of them on, with only its
    live tracks in memory.
    """
    span = TRACK_SEGMENT * C.DETECTION_INTERVAL
    seg = F.floor(F.col("frame_no") / span)
    ahead = F.col("frame_no") % span >= span - TRACK_WARM_UP * C.DETECTION_INTERVAL
    own = rows.select("*", seg.alias("seg"), F.lit(False).alias("warm"), F.lit(None).cast("string").alias("live"))
    early = rows.where(ahead).select("*", (seg + 1).alias("seg"), F.lit(True).alias("warm"), F.lit(None).cast("string").alias("live"))
    own = checkpoint(own)
    pieces = [checkpoint(_fold_segments(own.unionByName(early)).withColumn("round", F.lit(0)))]
    states = checkpoint(pieces[0].where("kind <> 'box'"))
    while True:
        ends = states.where("kind = 'end'").select("video_id", "stretch", (F.col("seg") + 1).alias("seg"), F.col("live").alias("_want"))
        wrong = checkpoint(states.where("kind = 'start'").join(dealt(ends), _PIECE).where("live <> _want").select(*_PIECE, "_want"))
        if wrong.isEmpty():
            break
        again, gone = own.join(dealt(wrong.drop("_want")), _PIECE, "left_semi"), wrong
        if len(pieces) > TRACK_ROUNDS:
            # Tracks of this stretch never forget their start: from its first wrong seam on it is one segment.
            first = wrong.groupBy("video_id", "stretch").agg(F.min("seg").alias("_first"))
            wrong = checkpoint(wrong.join(dealt(first), ["video_id", "stretch"]).where("seg = _first").drop("_first"))
            again = own.join(dealt(first), ["video_id", "stretch"]).where("seg >= _first").withColumn("seg", F.col("_first")).drop("_first")
            gone = states.join(dealt(first), ["video_id", "stretch"]).where("seg >= _first").select(*_PIECE).distinct()
        # A row before all others brings the live tracks; its numbers mean nothing.
        fixed = {"frame_no": -1, "warm": True, "type": "", "is_auth": False}
        heads = wrong.select(*[F.col(c) if c in _PIECE else F.col("_want").alias(c) if c == "live" else F.lit(fixed.get(c, 0)).cast(own.schema[c].dataType).alias(c)
                               for c in own.columns])
        redone = _fold_segments(again.unionByName(heads))
        pieces.append(checkpoint(redone.withColumn("round", F.lit(len(pieces)))))
        states = checkpoint(states.join(dealt(gone), _PIECE, "left_anti").unionByName(pieces[-1].where("kind <> 'box'")))

    def carry(known: dict, row: tuple) -> tuple[dict, list]:
        """Numbers and authorisation of the tracks a segment inherits."""
        if row.kind == "start":
            known["in"] = known["live"]
            return known, []
        inherited, ids = known["in"], json.loads(row.ids)
        out = [(row.video_id, row.stretch, row.seg, row.round, known["begun"], json.dumps([{"id": i, "known": a} for i, a in inherited]))]
        known["live"] = [[inherited[-1 - i][0], inherited[-1 - i][1] or a] if i < 0 else [known["begun"] + i, a] for i, a in ids]
        known["begun"] += int(row.fresh)
        return known, out

    named = checkpoint(ordered_fold(
        states.select(*_PIECE, "kind", "round", "ids", "fresh"), ["video_id", "stretch"], [F.col("seg"), F.col("kind").desc()],
        lambda: {"live": [], "in": [], "begun": 0}, carry, lambda known: [],
        "video_id bigint, stretch int, seg bigint, round int, begun bigint, inherited string"))
    named = named.withColumn("inherited", F.from_json("inherited", "array<struct<id:bigint,known:boolean>>"))
    boxes = reduce(DataFrame.unionByName, pieces).where("kind = 'box'").join(dealt(named), [*_PIECE, "round"])
    mine = F.get("inherited", (-1 - F.col("track_id")).cast("int"))
    return boxes.select(*FRAME, "stretch", F.when(F.col("track_id") < 0, mine["id"]).otherwise(F.col("begun") + F.col("track_id")).alias("track_id"), *BOX, "type",
                        (F.col("authorised") | ((F.col("track_id") < 0) & F.coalesce(mine["known"], F.lit(False)))).alias("authorised"))


def track(dets: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Boxes with track numbers on every frame from detection to detection.

    ``videos`` gives each video's number of frames, up to which boxes are
    predicted; without it a video ends with its last detection. Faces and
    plates are what is tracked; text boxes are carried on as they stand.

    Tracks die where a detection frame sees nothing, so a video falls into
    stretches of detection frames without a gap. A stretch of any length is cut into
    segments that are tracked side by side and stitched; numbers are then shifted by
    the tracks begun earlier.
    """
    known = F.col("is_auth") if "is_auth" in dets.columns else F.lit(False)
    dets = dets.withColumn("is_auth", F.coalesce(known, F.lit(False)))
    if videos is None:
        last = dets.groupBy("video_id").agg(F.max("frame_no").alias("last_frame"))
    else:
        last = videos.select("video_id", (F.col("frames") - 1).alias("last_frame"))
    seen = detection_frames(dets).join(dealt(last), "video_id")
    cut = bands(seen, ["video_id"], "frame_no", F.col("frame_no") + C.DETECTION_INTERVAL, "stretch")
    local = _stitched(cut.select(*FRAME, "stretch", "det_id", *BOX, "type", "is_auth", "last_frame"))
    begun = local.groupBy("video_id", "stretch").agg(F.max("track_id").alias("n"))
    earlier = Window.partitionBy("video_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    shift = begun.select("video_id", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return local.join(dealt(shift), ["video_id", "stretch"]).select(
        *FRAME, (F.col("track_id") + F.col("shift")).alias("track_id"), *BOX, "type", "authorised")


def sticky_authorised(rows: DataFrame, keys: list[str], frame: str = "frame_no", flag: str = "is_auth") -> DataFrame:
    """Once a track was recognised it stays authorised on later frames."""
    first = rows.where(F.col(flag)).groupBy(*keys).agg(F.min(frame).alias("_since"))
    return rows.join(dealt(first), keys, "left").withColumn(
        "authorised", F.coalesce(F.col(frame) >= F.col("_since"), F.lit(False))).drop("_since")


#: Vectors to a block of the comparison; pivots at most, whatever the number of references.
MATCH_BLOCK, MOST_PIVOTS = 1024, 256


def _distances(own, others):
    """Euclidean distances of all rows to all others, by one product."""
    import numpy as np

    return np.sqrt(np.maximum((own**2).sum(1)[:, None] + (others**2).sum(1) - 2 * own @ others.T, 0))


def _slack(own, others) -> float:
    """More than what rounding can take from a distance."""
    return 1e-6 * (1 + max(float(abs(m).max(initial=0)) * m.shape[1] ** 0.5 for m in (own, others)))


def _rows_of(column):
    """A matrix from a column of equally long lists."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def pivot_keys(rows: DataFrame, pivots, limit: float | None = None) -> DataFrame:
    """Add each row's reach: of its nearest pivot or, with a limit, of every pivot that can
    be the nearest of a row closer than that, the cell and the least and greatest
    distance from the pivot that the row, or such a row, can have.

    A row nearest to pivot p and closer than the limit to v has v no further from
    p than from any other pivot plus twice the limit.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    def run(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            own = _rows_of(batch.column(1))
            gaps, slack = _distances(own, pivots), _slack(own, pivots)
            near = np.arange(len(pivots)) == gaps.argmin(1)[:, None] if limit is None else gaps <= gaps.min(1)[:, None] + 2 * (limit + slack)
            wide = slack + (limit or 0)
            reach = [[{"cell": int(c), "low": float(g[c] - wide), "high": float(g[c] + wide)} for c in np.flatnonzero(n)] for g, n in zip(gaps, near)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(reach, kind)], names=["id", "v", "reach"])

    return rows.select("id", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, reach array<struct<cell:int,low:double,high:double>>")


def _blocks(vectors: DataFrame, refs: DataFrame, limit: float) -> DataFrame:
    """Blocks of vectors beside the blocks of references that may be closer than the limit."""
    import numpy as np

    n = refs.count()
    pivots = np.array([r[0] for r in refs.orderBy(F.xxhash64("v")).limit(max(1, min(MOST_PIVOTS, n // MATCH_BLOCK))).select("v").collect()], np.float64)
    placed = checkpoint(pivot_keys(refs.select(F.lit(0).alias("id"), "v"), pivots).select("v", F.inline("reach")))
    # A cell is cut into rings, by the distance from its pivot, and those into chunks.
    cells = placed.groupBy("cell").agg(F.min("low").alias("_low"), (F.max("low") - F.min("low")).alias("_span"), F.ceil(F.count("*") / MATCH_BLOCK).alias("_rings"))
    ring = F.least(F.col("_rings") - 1, F.floor((F.col("low") - F.col("_low")) / F.greatest("_span", F.lit(1e-12)) * F.col("_rings"))).cast("int")
    placed = placed.join(F.broadcast(cells), "cell").select("v", "cell", "low", "high", ring.alias("ring"))
    rings = checkpoint(placed.groupBy("cell", "ring").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"), F.ceil(F.count("*") / MATCH_BLOCK).cast("int").alias("chunks")))
    key = ["cell", "ring", "chunk"]
    chunked = placed.join(dealt(rings.select("cell", "ring", "chunks")), ["cell", "ring"]).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    known = chunked.groupBy(*key).agg(F.collect_list("v").alias("refs"))
    spread = F.pmod(F.xxhash64("id", "v"), F.lit(max(1, vectors.count() // MATCH_BLOCK)))
    reach = pivot_keys(vectors, pivots, limit).select("id", "v", spread.alias("block"), F.inline("reach"))
    close = (F.col("low") <= F.col("_high")) & (F.col("high") >= F.col("_low"))
    sent = reach.join(dealt(rings), "cell").where(close).select("id", "v", "block", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    grouped = sent.groupBy(*key, "block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
    return grouped.join(dealt(known), key)


def match_identities(
    vectors: DataFrame, refs: DataFrame, limit: float = C.FACE_MATCH_DISTANCE, ident: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Distinct ids of vectors nearer than ``limit`` to any reference: an exact range join by pivots.

    References belong to the cell of their nearest pivot and to a ring around it.
    By the triangle inequality a vector can only be near those in cells and
    rings that its own distances to the pivots allow; it is sent to no others. What
    meets is compared in blocks of bounded size, so a cell of any size is
    spread over tasks and no set of vectors or references passes the driver (only
    the pivots do, 256 at most). Rows with a null vector take no part.
    """
    import pyarrow as pa

    kind = vectors.schema[ident].dataType.simpleString()
    known = refs.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct()
    known = checkpoint(known)
    if known.isEmpty():
        return vectors.select(ident).limit(0)

    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                ids, own, table = (batch.column(n).slice(i, 1).flatten() for n in ("ids", "vs", "refs"))
                own, table = _rows_of(own), _rows_of(table)
                gaps = _distances(own, table)
                near = gaps < limit
                # The product rounds; what is close to the limit is measured again.
                for j, k in zip(*np.nonzero(np.abs(gaps - limit) < _slack(own, table))):
                    near[j, k] = np.sqrt(((own[j] - table[k])**2).sum()) < limit
                yield pa.record_batch([ids.filter(pa.array(near.any(1)))], names=["id"])

    met = _blocks(checkpoint(rows), known, limit).select("ids", "vs", "refs")
    return met.mapInArrow(run, f"id {kind}").distinct().select(F.col("id").alias(ident))


def policies(spark) -> DataFrame:
    """The seven redaction policies as a table."""
    rows = [(mode, *flags) for mode, flags in C.POLICIES.items()]
    return spark.createDataFrame(rows, "mode string, redact_faces boolean, redact_plates boolean, redact_pii boolean, keep_authorized boolean")


def apply_policy(dets: DataFrame, authorised: str = "authorised") -> DataFrame:
    """Whether each detection is redacted under its ``mode``; seven policies are broadcast."""
    ruled = dets.join(F.broadcast(policies(dets.sparkSession)), "mode")
    redact = (
        F.when(F.col("type") == "face", F.col("redact_faces") & ~(F.col("keep_authorized") & F.col(authorised)))
        .when(F.col("type") == "plate", F.col("redact_plates")).otherwise(F.col("redact_pii")))
    return ruled.withColumn("redact", redact)


def frame_risk(dets: DataFrame) -> DataFrame:
    """Risk points per frame and per video (frame_no null), capped."""
    points = F.lit(C.FRAME_RISK_DEFAULT)
    for kind, value in C.FRAME_RISK_POINTS.items():
        points = F.when(F.lower("type") == kind, value).otherwise(points)
    sums = dets.withColumn("points", points).groupingSets([["video_id", "frame_no"], ["video_id"]], "video_id", "frame_no")
    return sums.agg(F.least(F.lit(C.RISK_CAP).cast("bigint"), F.sum("points")).alias("risk"))


def report(dets: DataFrame, fps: float, videos: DataFrame | None = None) -> DataFrame:
    """One privacy report per video; ``dets`` are the redacted boxes.

    ``videos`` gives the number of frames of every video, those without a box
    included; without it only frames with boxes count.
    """
    frames = videos.select("video_id", "frames") if videos is not None else dets.groupBy("video_id").agg(
        F.countDistinct("frame_no").alias("frames"))
    return report_of_counts(dets.groupBy("video_id", "type").agg(F.count("*").alias("n")), frames, fps)


def report_of_counts(kinds: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """The privacy reports from counts n per video and type, and the number of frames per video."""
    low = F.lower("type")
    points = F.lit(C.REPORT_TEXT_DEFAULT)
    for part, value in reversed(C.REPORT_TEXT_POINTS):
        points = F.when(low.contains(part), value).otherwise(points)
    points = F.when(F.col("type") == "face", C.REPORT_FACE_POINTS).when(F.col("type") == "plate", C.REPORT_PLATE_POINTS).otherwise(points)
    is_text = ~F.col("type").isin("face", "plate")
    per_video = kinds.groupBy("video_id").agg(
        F.coalesce(F.sum(F.when(F.col("type") == "face", F.col("n"))), F.lit(0)).alias("faces_redacted"),
        F.coalesce(F.sum(F.when(F.col("type") == "plate", F.col("n"))), F.lit(0)).alias("plates_redacted"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(is_text, F.struct("type", "n"))))).alias("pii_detected"),
        F.least(F.lit(C.RISK_CAP).cast("bigint"), F.sum(F.col("n") * points)).alias("privacy_risk_score"),
        F.lit(C.RISK_CAP).alias("max_score"))
    length = F.col("frames") / F.lit(float(fps)) if fps else F.lit(0.0)
    none = F.lit(0).cast("bigint")
    return frames.join(dealt(per_video), "video_id", "left").select(
        "video_id", length.alias("video_duration_sec"), F.coalesce("faces_redacted", none).alias("faces_redacted"),
        F.coalesce("plates_redacted", none).alias("plates_redacted"),
        F.coalesce("pii_detected", F.create_map().cast("map<string,bigint>")).alias("pii_detected"),
        F.coalesce("privacy_risk_score", none).alias("privacy_risk_score"), F.lit(C.RISK_CAP).alias("max_score"))


def report_json(reports: DataFrame) -> DataFrame:
    fields = [c for c in reports.columns if c != "video_id"]
    return reports.select("video_id", F.to_json(F.struct(*fields)).alias("report"))
