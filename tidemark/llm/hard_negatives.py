"""Hard negatives by rotated one-bit codes, with intervals that never lose a candidate.

A vector o of whole numbers is spread over ``rotations`` random rotations, P = [R1; R2; ...] / sqrt(rotations), so that P'P = I, and
only the signs b of P o are kept, as a packed code. The code stands for the unit vector g = P'b / |P'b|. Stored beside it are |P'b|, the
alignment <o, g> and the length of what g misses, off = sqrt(|o|^2 - <o, g>^2).

For an anchor q, P q is rounded to a few bit planes; q' is the vector that the rounded values stand for, and e = q - q'. Counting common
bits of planes and codes gives <q', g> without rounding, hence the estimate <o, g> <q', g>. By Cauchy-Schwarz the score lies within
    off * sqrt(|q'|^2 - <q', g>^2) + |e| |o|
of it. A row whose interval misses the wanted window, or ends below the k-th best score already known, cannot be an answer; the scores of
all surviving rows are computed in whole numbers. So codes decide the work and never the result.

Rows and anchors are hashed to blocks, and every cell of the grid (block of rows, block of anchors) is one group: anchors are a fixed fraction of
the rows, so this is a stated query set against all rows, in blocks. A cell returns at most k rows for each of its anchors.

Defined results. Rows take no part if the label or the vector is null or the vector is empty or holds a null, a non-finite entry or one whose scaled form
is 2**28 or more. Vectors of different length do not meet. Null ids are ordinary rows, come after all ids among ties, and are no anchors. Rows that
carry the anchor's id are not its others. Equal anchor rows count once, equal candidates as often as they occur. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.distributed import materialize, top_per_key

LARGEST = float(2**28)
PLANES = 5
SEEDS = 64
GATHERED = 16
CODED = "id long, no_id boolean, label long, x binary, code binary, width double, along double, off double"


@lru_cache(maxsize=8)
def rotation(length: int, rotations: int) -> np.ndarray:
    """(rotations * length, length), orthonormal columns, the same in every task."""
    rng = np.random.default_rng(length)
    stack = [np.linalg.qr(rng.standard_normal((length, length)))[0] for _ in range(rotations)]
    return np.concatenate(stack) / np.sqrt(rotations)


def encode(x: np.ndarray, rotations: int) -> dict[str, np.ndarray]:
    """Codes of the rows of x (packed to 64-bit words) with width |P'b|, alignment and missing length."""
    spread = rotation(x.shape[1], rotations)
    bits = x @ spread.T > 0
    back = np.where(bits, 1.0, -1.0) @ spread
    width = np.linalg.norm(back, axis=1)
    along = (x * back).sum(axis=1) / width
    off = np.sqrt(np.maximum((x * x).sum(axis=1) - along * along, 0.0))
    packed = np.packbits(bits, axis=1, bitorder="little")
    return {"code": np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))), "width": width, "along": along, "off": off}


def coded_rows(vectors: DataFrame, key: str, vec: str, label: Column, scale: float, rotations: int) -> DataFrame:
    """All rows that take part, as whole numbers with their codes."""
    scaled = lambda c: F.floor(c.cast("double") * scale)
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * scale) < LARGEST, F.lit(False))
    v = F.col(vec)
    taking_part = v.isNotNull() & (F.size(v) > 0) & F.forall(v, fits) & label.isNotNull()
    rows = vectors.where(taking_part).select(
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("id"), F.col(key).isNull().alias("no_id"), label.cast("long").alias("label"),
        F.transform(v, lambda c: scaled(c).cast("int")).alias("x"),
    )

    def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                x = part.column("x").flatten().to_numpy().reshape(-1, length).astype("<i4")
                found = encode(x.astype(np.float64), rotations)
                as_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                same = [part.column(c) for c in ("id", "no_id", "label")]
                numbers = [pa.array(found[c]) for c in ("width", "along", "off")]
                names = ["id", "no_id", "label", "x", "code", "width", "along", "off"]
                yield pa.RecordBatch.from_arrays([*same, as_bytes(x), as_bytes(found["code"]), *numbers], names)

    return rows.mapInArrow(add_codes, CODED)


class Block:
    """Rows of one cell and one vector length, sorted by label, ready to be compared with anchors."""

    def __init__(self, rows: pd.DataFrame, length: int):
        rows = rows.sort_values("label", kind="stable")
        joined = lambda c, kind: np.frombuffer(b"".join(rows[c]), dtype=kind).reshape(len(rows), -1)
        self.ids, self.no_id = rows["id"].to_numpy(), rows["no_id"].to_numpy(dtype=bool)
        self.labels = rows["label"].to_numpy()
        whole = joined("x", "<i4")
        self.x = whole.astype(np.float64)
        self.codes = np.ascontiguousarray(joined("code", "<u8").T)
        self.width, self.along, self.off = (rows[c].to_numpy() for c in ("width", "along", "off"))
        self.norm = np.hypot(self.along, self.off)
        self.ones = np.bitwise_count(self.codes).sum(axis=0, dtype=np.int64)
        self.most = np.abs(self.x).max(initial=0.0)
        self.exact = self.most**2 * length < 2**51
        self.whole = whole

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def intervals(self, q: np.ndarray, at: slice, rotations: int) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, half width) of the scores of some rows with an anchor."""
        spread = rotation(len(q), rotations)
        turned = spread @ q
        top = np.abs(turned).max()
        step = top / (2 ** (PLANES - 1) - 1) if top > 0 else 1.0
        levels = np.rint(turned / step).astype(np.int64)
        meant = (levels * step) @ spread
        raised = levels + 2 ** (PLANES - 1)
        counts = np.zeros(self.codes[:, at].shape[1], dtype=np.int64)
        for plane in range(PLANES):
            packed = np.packbits((raised >> plane) & 1 == 1, bitorder="little")
            words = np.pad(packed, (0, -len(packed) % 8)).view("<u8")
            common = np.zeros(len(counts), dtype=np.int32)
            for word, mine in zip(words, self.codes, strict=True):
                common += np.bitwise_count(mine[at] & word)
            counts += common.astype(np.int64) << plane
        # <levels, b> with b = 2 * bit - 1 and levels = raised - 2^(PLANES - 1)
        signed = 2 * counts - int(raised.sum()) - 2 ** (PLANES - 1) * (2 * self.ones[at] - len(levels))
        across = signed * step / self.width[at]
        missed = np.sqrt(np.maximum(meant @ meant - across * across, 0.0))
        half = self.off[at] * missed + np.linalg.norm(q - meant) * self.norm[at]
        return self.along[at] * across, half + 1e-9 * (self.norm[at] * np.linalg.norm(q)) + 1e-6

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact whole-number scores: a float product while all sums stay below 2**53, else 64-bit integers.

        Of many rows the whole block is multiplied as it lies, which costs less than to gather them first.
        """
        if self.exact and np.abs(q).max(initial=0.0) * self.most * len(q) < 2**53:
            return ((self.x @ q)[at] if len(at) > len(self.x) // GATHERED else self.x[at] @ q).astype(np.int64)
        return self.whole[at].astype(np.int64) @ q.astype(np.int64)

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the first k rows: higher scores, then smaller ids, null ids last."""
        if len(at) > 4 * k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            kept = np.flatnonzero(scores >= floor)
        else:
            kept = np.arange(len(at))
        order = np.lexsort((self.ids[at[kept]], self.no_id[at[kept]], -scores[kept]))
        return kept[order[:k]]

    def others(self, at: slice, anchor_id: int) -> np.ndarray:
        return (self.ids[at] != anchor_id) | self.no_id[at]


def best_estimates(estimate: np.ndarray, n: int) -> np.ndarray:
    return np.arange(len(estimate)) if len(estimate) <= n else np.argpartition(estimate, len(estimate) - n)[-n:]


def positives_of(block: Block, q: np.ndarray, label: int, anchor_id: int, k: int, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (places, scores) of the first k others of the anchor's label."""
    at = block.of_label(label)
    places = np.flatnonzero(block.others(at, anchor_id)) + at.start
    if not len(places):
        return places, np.zeros(0, dtype=np.int64)
    estimate, half = (v[places - at.start] for v in block.intervals(q, at, rotations))
    known = block.scores(q, places[best_estimates(estimate, SEEDS)])
    floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
    places = places[estimate + half >= floor]
    scores = block.scores(q, places)
    best = block.first(places, scores, k)
    return places[best], scores[best]


def negatives_of(
    block: Block, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int, rotations: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores the first k rows (places, scores) of other labels inside it."""
    own = block.of_label(label)
    estimate, half = block.intervals(q, slice(0, len(block.ids)), rotations)
    low, high = estimate - half, estimate + half
    low[own], high[own] = np.inf, -np.inf
    known = np.full(len(low), np.iinfo(np.int64).min)
    wanted = np.zeros(len(low), dtype=bool)
    for least, most in windows:
        inside = np.flatnonzero((high >= least) & (low <= most))
        likely = inside[estimate[inside] <= most]
        seeds = likely[best_estimates(estimate[likely], SEEDS)]
        fresh = seeds[known[seeds] == np.iinfo(np.int64).min]
        known[fresh] = block.scores(q, fresh)
        hits = known[seeds][(known[seeds] >= least) & (known[seeds] <= most)]
        floor = np.partition(hits, len(hits) - k)[len(hits) - k] if len(hits) >= k else least
        wanted[inside[high[inside] >= floor]] = True
    at = np.flatnonzero(wanted)
    scores = block.scores(q, at)
    out = []
    for least, most in windows:
        fits = np.flatnonzero((scores >= least) & (scores <= most))
        best = fits[block.first(at[fits], scores[fits], k)]
        out.append((at[best], scores[best]))
    return out


def grid(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, row_block: int, anchor_block: int):
    """Both sides grouped by cell. Block numbers follow from hashes of the whole row, so equal ids do not meet in one block by force."""
    row_blocks, anchor_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_anchors // anchor_block))
    left = rows.withColumns({
        "rb": F.pmod(F.xxhash64("id", "no_id", "x"), F.lit(row_blocks)), "ab": F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1)))
    })
    right = anchors.withColumns({
        "ab": F.pmod(F.xxhash64("anchor"), F.lit(anchor_blocks)).cast("int"),
        "rb": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))),
    })
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab"))


def blocks_by_length(rows: pd.DataFrame) -> dict[int, Block]:
    sizes = rows["x"].map(len) // 4
    return {int(n): Block(part, int(n)) for n, part in rows.groupby(sizes)}


def vector_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4").astype(np.float64)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({c: [] for c in names})


POSITIVES = ["anchor", "id", "no_id", "score"]
NEGATIVES = ["anchor", "anchor_id", "place", "positive", "no_positive", "positive_score", "id", "no_id", "score"]


def mine(
    vectors: DataFrame,
    key: str,
    vec: str,
    label: Column,
    anchors: Callable[[Column], Column],
    n_positives: int = 5,
    n_negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    scale: float = 256,
    rotations: int = 4,
    row_block: int = 16_384,
    anchor_block: int = 32_768,
) -> DataFrame:
    """Hard negatives of every (anchor, positive); ``window`` bounds the negative's score in percent of the positive's.

    ``anchors`` tells from an id whether the row is an anchor. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = materialize(coded_rows(vectors, key, vec, label, scale, rotations), "coded-vectors")
    chosen = rows.where(~F.col("no_id") & anchors(F.col("id")))
    unique = chosen.select("id", "label", "x").distinct().withColumn("anchor", F.xxhash64("id", "label", "x"))
    asking = materialize(unique.withColumnRenamed("id", "anchor_id").withColumnRenamed("label", "anchor_label").withColumnRenamed("x", "q"), "anchors")
    n_rows, n_anchors = rows.count(), asking.count()

    def find_positives(mine_: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        blocks, out = blocks_by_length(mine_), []
        for a in theirs.itertuples():
            block = blocks.get(len(a.q) // 4)
            if block:
                places, scores = positives_of(block, vector_of(a.q), a.anchor_label, a.anchor_id, n_positives, rotations)
                out += [(a.anchor, block.ids[p], block.no_id[p], s) for p, s in zip(places, scores, strict=True)]
        return _frame(out, POSITIVES)

    cells = grid(rows, asking, n_rows, n_anchors, row_block, anchor_block)
    near = cells.applyInPandas(find_positives, "anchor long, id long, no_id boolean, score long")
    order = [F.desc("score"), F.asc("no_id"), F.asc("id")]
    best = top_per_key(near, ["anchor"], order, n_positives, out="place")
    listed = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "no_id", "score"))).alias("positives"))
    informed = materialize(asking.join(listed, "anchor"), "anchors-with-positives")
    least, most = window

    def find_negatives(mine_: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        blocks, out = blocks_by_length(mine_), []
        for a in theirs.itertuples():
            block = blocks.get(len(a.q) // 4)
            if not block:
                continue
            windows = [(-(-least * p["score"] // 100), most * p["score"] // 100) for p in a.positives]
            found = negatives_of(block, vector_of(a.q), a.anchor_label, windows, n_negatives, rotations)
            for p, (places, scores) in zip(a.positives, found, strict=True):
                head = (a.anchor, a.anchor_id, p["place"], p["id"], p["no_id"], p["score"])
                out += [(*head, block.ids[i], block.no_id[i], s) for i, s in zip(places, scores, strict=True)]
        return _frame(out, NEGATIVES)

    schema = "anchor long, anchor_id long, place int, positive long, no_positive boolean, positive_score long, id long, no_id boolean, score long"
    far = grid(rows, informed, n_rows, n_anchors, row_block, anchor_block).applyInPandas(find_negatives, schema)
    ranked = top_per_key(far, ["anchor", "place"], order, n_negatives)
    return ranked.select(
        "anchor_id",
        F.when(~F.col("no_positive"), F.col("positive")).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.when(~F.col("no_id"), F.col("id")).alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


SQL = """
    with v as (
        select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
            list_transform(embedding, lambda c: floor(256 * c::double)) as x
        from embeddings
        where label is not null and embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
    a as (select distinct * from v where vec_id % 100 = 0),
    s as (
        select a.vec_id as anchor_id, a.label as anchor_label, v.vec_id, v.label, list_inner_product(a.x, v.x)::bigint as score
        from a join v on v.vec_id is distinct from a.vec_id and len(a.x) = len(v.x)),
    p as (
        select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as place
        from s where label = anchor_label),
    n as (
        select s.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
            row_number() over (partition by s.anchor_id, p.place order by s.score desc, s.vec_id) as rank
        from p join s using (anchor_id)
        where p.place <= 5 and s.label <> s.anchor_label and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
