"""Operator 1: near-duplicate detection with ProbMinHash, banding and exact verification.

Each distinct text is a bag of five-word shingles weighted by how often they occur. Every shingle is a Poisson process
whose rate is its weight; its arrivals fall on random registers, and a register keeps the shingle that arrived first.
Two texts agree in a register with the probability Jaccard similarity of their bags. A process ends as soon as its next
arrival is later than every register, so after the first round few shingles are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verisheaf.llm.common import SPACE, mix64, read_table, shingle_hashes, stage_table, text_buffer, text_of, word_hashes

WIDTH, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^30, all but 7 in a million.
BANDS, ROWS = 30, 5
#: Bytes of text hashed at once, which bounds a worker's memory unless one text is longer.
SLICE_BYTES = 1 << 21
#: Members that are compared with their leader in one task.
FAMILY = 512
#: Sizes of texts at most this far apart are judged by by_differences even where shingles are shared in unlike numbers.
RATIO = 1.25**2
#: The pairs of a list are met in one task if they are so many at most, else in blocks of about BLOCK pairs.
SMALL, BLOCK = 1 << 22, 1 << 22

_STEP = 0xD1342543DE82EF95


def _seed(k: int) -> np.uint64:
    return np.uint64(_STEP * k % (1 << 64))


def _weighted(raw, offsets, width):
    """Row, shingle and weight of each distinct shingle of each row, ordered by row."""
    words, counts = word_hashes(raw, offsets, SPACE[raw])
    hashes, starts = shingle_hashes(words, counts, width)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    if not len(hashes):
        return rows, hashes, np.zeros(0)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows))).astype(np.float64)


def prob_minhash(rows, hashes, weights, n_rows: int, m: int) -> np.ndarray:
    """ProbMinHash signatures, n_rows times m: the shingle that arrived first at each register. A row without shingles
    has zeros."""
    first = np.full(n_rows * m, np.inf)
    who = np.zeros(n_rows * m, dtype=np.uint64)
    at, row, turn = np.zeros(len(hashes)), rows, 0
    seed, rate = hashes, weights
    while len(seed):
        u = mix64(seed + _seed(2 * turn + 1))
        at = at - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
        limit = first.reshape(n_rows, m).max(axis=1)[row]
        alive = at < limit
        if not alive.all():
            at, row, seed, rate = at[alive], row[alive], seed[alive], rate[alive]
        v = mix64(seed + _seed(2 * turn + 2))
        slot = row * m + ((v >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(at < first[slot])
        better = better[np.argsort(-at[better], kind="stable")]  # of several writes to a register the last holds
        first[slot[better]] = at[better]
        who[slot[better]] = seed[better]
        turn += 1
    return who.reshape(n_rows, m)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(signatures), bands), dtype=np.uint64)
    for b in range(bands):
        total = np.full(len(signatures), np.uint64(b + 1), dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            total = mix64(total * _seed(1) + signatures[:, k])
        out[:, b] = total
    return out.view(np.int64)


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Consecutive (from, to) rows of a string column whose bytes stay within limit, at least one row each."""
    _, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def sketcher(bands: int, rows: int, width: int):
    """For mapInArrow: (doc_id, key, norm, uid) to (doc_id, key, uid, bands); bands is empty where there is no word."""

    def run(batches):
        for batch in batches:
            text = batch.column(2)
            for at, to in slices(text):
                raw, offsets = text_buffer(text.slice(at, to - at))
                parts = _weighted(raw, offsets, width)
                n = to - at
                hashes = band_hashes(prob_minhash(*parts, n, bands * rows), bands, rows)
                some = np.bincount(parts[0], minlength=n) > 0
                ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[some].reshape(-1)))
                columns = [*(batch.column(k).slice(at, n) for k in (0, 1, 3)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "uid", "bands"])

    return run


def similarity(a_hash, a_weight, b_hash, b_weight) -> float:
    """Probability Jaccard similarity of two bags: the sum, over shared shingles d, of
    1 / sum over all d' of max(a(d') / a(d), b(d') / b(d))."""
    if not len(a_hash) or not len(b_hash):
        return float(len(a_hash) == len(b_hash))
    both, ia, ib = np.intersect1d(a_hash, b_hash, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    only_b = np.ones(len(b_hash), dtype=bool)
    only_b[ib] = False
    a = np.concatenate([a_weight, np.zeros(only_b.sum())])
    b = np.zeros(len(a))
    b[ia] = b_weight[ib]
    b[len(a_weight) :] = b_weight[only_b]
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio, kind="stable")
    below_a = np.concatenate([[0.0], np.cumsum(a[order])])
    below_b = np.concatenate([[0.0], np.cumsum(b[order])])
    mine = ratio[ia]
    k = np.searchsorted(ratio[order], mine, side="left")
    return float(np.sum(b[ia] / (mine * below_a[k] + below_b[-1] - below_b[k])))


#: Words of a bitmap of the occurrences in which a text differs from its leader.
MARK_WORDS = 32
_COMPARED = (
    "id long, leader long, similarity double, size long, leader_size long, missing long, extra long, uneven long, "
    "repeats long, heavy boolean, hash array<long>, own array<int>, theirs array<int>, marks array<long>"
)


def _marks(hashes, low, high) -> np.ndarray:
    """Bitmap of the occurrences low + 1 to high of each shingle."""
    n = (high - low).astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n).astype(np.int64)
    bit = mix64(np.repeat(hashes, n) + nth.astype(np.uint64) * _seed(3)) % np.uint64(64 * MARK_WORDS)
    out = np.zeros(MARK_WORDS, dtype=np.uint64)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def difference(a_hash, a_weight, b_hash, b_weight):
    """The shingles whose weights differ in two bags: hash, weight in a, weight in b. Hashes ascend in both bags."""
    hashes = np.union1d(a_hash, b_hash)
    own, theirs = np.zeros(len(hashes)), np.zeros(len(hashes))
    own[np.searchsorted(hashes, a_hash)] = a_weight
    theirs[np.searchsorted(hashes, b_hash)] = b_weight
    differ = own != theirs
    return hashes[differ], own[differ], theirs[differ]


def unevenness(size, leader_size, own, theirs) -> tuple[int, int, bool]:
    """uneven, repeats and heavy of a text that differs from its leader in shingles of weight own here and theirs there.

    Of two members, the shingles that both have in unlike numbers count, each by its lower number, at most the sum of
    their uneven, unless both have some repeatedly that the leader lacks; then at most the lesser of their repeats more.
    A heavy member is one that may be similar to a member of quite another size: of two others, with sizes at a ratio k
    over RATIO, unlike shingles would have to make up (0.8 - 1 / k) / (1 - 1 / k), which is 0.44 or more, of the smaller
    text, and they are at most 0.1 of the leader where that text is 0.25 of it."""
    fewer = (own > 0) & (own < theirs)
    more = (theirs > 0) & (own > theirs)
    new = (theirs == 0) & (own > 1)
    heavy = np.maximum(own, theirs)[fewer | more].sum() + new.sum() > 0.05 * leader_size or size < 0.25 * leader_size
    return int(own[fewer].sum() + (own[more] - 1).sum() + new.sum()), int(own[new].sum()), bool(heavy)


def comparer(width: int):
    """For mapInArrow over (leader, role, id, norm), sorted so that a leader's text (role 0) comes before its members':
    each member against its leader, as _COMPARED. hash, own and theirs are the shingles of differing weight; missing and
    extra add up what the member lacks and has beyond its leader."""

    def run(batches):
        head: tuple = (None, None, None)
        last = None
        for batch in batches:
            leaders, roles, ids, text = (batch.column(k) for k in range(4))
            leaders, roles, ids = leaders.to_pylist(), roles.to_pylist(), ids.to_pylist()
            for at, to in slices(text):
                rows, hashes, weights = _weighted(*text_buffer(text.slice(at, to - at)), width)
                cut = np.searchsorted(rows, np.arange(to - at + 1))
                out: list[list] = [[] for _ in range(14)]
                for i in range(at, to):
                    h, w = hashes[cut[i - at] : cut[i - at + 1]], weights[cut[i - at] : cut[i - at + 1]]
                    if roles[i] == 0:
                        head, last = (leaders[i], h, w), None
                    elif ids[i] != last:  # a row that repeats id and text comes right after it
                        last = ids[i]
                        hash_, own, theirs = difference(h, w, head[1], head[2])
                        uneven, repeats, heavy = unevenness(w.sum(), head[2].sum(), own, theirs)
                        lack, more = np.maximum(theirs - own, 0).sum(), np.maximum(own - theirs, 0).sum()
                        marks = _marks(hash_, np.minimum(own, theirs), np.maximum(own, theirs))
                        sums = (w.sum(), head[2].sum(), lack, more, uneven, repeats)
                        arrays = (hash_.view(np.int64), own.astype(np.int32), theirs.astype(np.int32), marks.view(np.int64))
                        row = (ids[i], head[0], similarity(h, w, head[1], head[2]), *map(int, sums), heavy, *arrays)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                ints, lists = pa.list_(pa.int32()), pa.list_(pa.int64())
                kinds = [pa.int64()] * 2 + [pa.float64()] + [pa.int64()] * 6 + [pa.bool_(), lists, ints, ints, lists]
                names = [field.split()[0] for field in _COMPARED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def similarity_of_members(a, b, leader_size: float) -> float:
    """Exact similarity of two texts from how each differs from one leader: (hash, own, theirs) of either. What neither
    differs in has one weight in both, so it counts as one shingle of that weight."""
    hashes = np.union1d(a[0], b[0])
    at, bt = np.searchsorted(hashes, a[0]), np.searchsorted(hashes, b[0])
    x = np.zeros(len(hashes) + 1)
    x[at], x[bt] = a[2], b[2]
    x[-1] = leader_size - x.sum()
    y = x.copy()
    x[at], y[bt] = a[1], b[1]
    ia, ib = np.flatnonzero(x), np.flatnonzero(y)
    return similarity(ia, x[ia], ib, y[ib])


def member_verifier():
    """For mapInArrow: (a, b, leader_size, differences of a, differences of b) to (a, b, similarity)."""

    def run(batches):
        for batch in batches:
            scores = []
            for i in range(batch.num_rows):
                arrays = [np.asarray(batch.column(k)[i].values) for k in range(3, 9)]
                scores.append(similarity_of_members(arrays[:3], arrays[3:], float(batch.column(2)[i].as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["a", "b", "similarity"])

    return run


def _blocks(work):
    """Blocks on a side into which the pairs of a list are dealt."""
    return F.when(work <= SMALL, F.lit(1)).otherwise(F.ceil(F.sqrt(work / BLOCK)).cast("int"))


def _meet(left: DataFrame, right: DataFrame, on: list[str], condition) -> DataFrame:
    """(leader, id, their_id) of the rows of left and right that agree in on and meet the condition, in which the right
    columns have their_ in front. Both hold blocks, the same for all rows of a list: pairs of a large list are dealt
    into blocks x blocks tasks."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    left = left.withColumn("row", own).withColumn("column", F.explode(every)).drop("blocks")
    right = right.withColumn("column", own).withColumn("row", F.explode(every)).drop("blocks")
    keys = [*on, "row", "column"]
    right = right.select(*keys, *[F.col(c).alias(f"their_{c}") for c in right.columns if c not in keys])
    return left.join(right, keys).where(condition).select("leader", "id", "their_id")


def _judged(rel: DataFrame, threshold: float) -> DataFrame:
    """rel with w, free and odd: whether a text has to be judged pair by pair (see by_differences)."""
    t = threshold
    slack = F.col("uneven") * ((RATIO - t) / (1 + t))
    rel = rel.withColumn("w", (F.col("missing") + t * F.col("extra")) / (1 + t) - slack)
    rel = rel.withColumn("free", F.col("leader_size") * ((1 - t) / (1 + t)))
    return rel.withColumn("odd", F.col("heavy") | (F.col("far") & (F.col("uneven") > 0) & (F.col("w") <= F.col("free"))))


def by_differences(rel: DataFrame, threshold: float) -> DataFrame:
    """Pairs (leader, id, their_id) of members of one leader that may be as similar as the threshold t, by a
    prefix-filtered join on what they differ from the leader in; but for those that by_sizes judges.

    Let m and e be the occurrences that a text misses and has beyond the leader of size n, w = (m + t e) / (1 + t), and
    o the differences that two texts share. If no shingle is in both in unlike numbers, their similarity reaches t if and
    only if o >= w + w' - n (1 - t) / (1 + t). If some are, of total weight r and with sizes at a ratio up to RATIO, it
    can only if o >= w + w' - n (1 - t) / (1 + t) - r (RATIO - t) / (1 + t), and w is made smaller by each text's part.
    A text of another class than the leader isn't linked with it, so gap = w - n (1 - t) / (1 + t) > 0 (if smaller w has
    no gap, it is odd). So o >= gap + w' for each partner, from which o >= (1 + t) gap follows: two texts meet in the
    first d - need + 1 of their d differences, in any order all members agree on. Rare ones come first, so what a whole
    family has in common is not met on. rel: members of families that hold several classes: leader, id, label, far (of
    another class than the leader), and the columns of _COMPARED."""
    t = threshold
    each = _judged(rel, t).where("not odd").withColumn("d", F.col("missing") + F.col("extra"))
    need = F.ceil(F.when(F.col("far"), (1 + t) * (F.col("w") - F.col("free"))).otherwise(F.col("w")) - 1e-6)
    each = each.withColumn("prefix", F.col("d") - F.greatest(need, F.lit(1)) + 1)
    each = each.withColumn("repeated", F.col("repeats") > 0)
    columns = ["leader", "id", "label", "far", "repeated", "w", "d", "prefix", "free"]
    at = each.where("prefix > 0").select(*columns, F.inline(F.arrays_zip("hash", "own", "theirs")))
    nth = F.explode(F.sequence(F.least("own", "theirs") + 1, F.greatest("own", "theirs")))
    at = at.select(*columns, "hash", nth.alias("nth")).select(*columns, F.xxhash64("hash", "nth").alias("element"))
    same = Window.partitionBy("leader", "element")
    far = F.col("far").cast("long")
    at = at.withColumn("held", F.count(F.lit(1)).over(same)).withColumn("n_far", F.sum(far).over(same))
    at = at.withColumn("low", F.min("label").over(same)).withColumn("high", F.max("label").over(same))
    # What only one class has, or only texts linked with the leader, can be shared by no pair that is looked for; it
    # comes first in the order.
    at = at.where("n_far > 0 and low <> high").drop("low", "high")
    mine = Window.partitionBy("leader", "id")
    rank = F.row_number().over(mine.orderBy("held", "element")) - F.count(F.lit(1)).over(mine)
    at = at.withColumn("place", F.col("d") + rank).where("place <= prefix")
    at = at.withColumn("blocks", _blocks(F.col("n_far") * F.col("held"))).drop("held", "n_far", "prefix")
    # A pair's first meeting leaves at most this much to share.
    rest = 1 + F.least(F.col("d") - F.col("place"), F.col("their_d") - F.col("their_place"))
    once = ~F.col("their_far") | (F.col("id") < F.col("their_id"))
    reach = F.col("w") + F.col("their_w") - F.col("free") <= rest + 1e-6
    at = stage_table(at, "near-elements")
    return _meet(at.where("far"), at, ["leader", "element"], (F.col("label") != F.col("their_label")) & ~(F.col("repeated") & F.col("their_repeated")) & once & reach)


def by_sizes(rel: DataFrame, threshold: float) -> DataFrame:
    """Pairs (leader, id, their_id) that may be as similar as the threshold t, of an odd text and another member of its
    leader or of two texts with repeats.

    Where shingles are shared in unlike numbers, of total weight r at most, similarity reaches t only if
    (1 + t) o + r (k - t) >= t (x + y) and o >= t min(x, y), for sizes x and y, their ratio k and an overlap of o, which
    is bounded from above by bitmaps of the differences from the leader. rel as in by_differences."""
    t = threshold
    rel = _judged(rel, t)
    family = rel.groupBy("leader").agg(
        F.sum(F.col("odd").cast("long")).alias("n_odd"), F.sum((F.col("repeats") > 0).cast("long")).alias("n_repeats"), F.count(F.lit(1)).alias("held")
    )
    family = family.where("n_odd > 0 or n_repeats > 1")
    family = family.select("leader", _blocks(F.col("n_odd") * F.col("held") + F.col("n_repeats") * F.col("n_repeats")).alias("blocks"))
    each = rel.select("leader", "id", "label", "far", "odd", "size", "leader_size", "missing", "extra", "uneven", "repeats", "marks").join(family, "leader")
    either = (F.col("marks")[k].bitwiseOR(F.col("their_marks")[k]) for k in range(MARK_WORDS))
    marked = F.col("missing") + F.col("extra") + F.col("their_missing") + F.col("their_extra") - sum((F.bit_count(x) for x in either), F.lit(0))

    def sharable(extra: str, repeats: str, uneven: str, others: str):
        """Of what a text has beyond the leader, repeats can be shared only once unless the other has some too."""
        return F.col(extra) - F.when(F.col(others) > 0, 0).otherwise(F.greatest(F.col(repeats) - F.col(uneven), F.lit(0)))

    beyond = F.least(sharable("extra", "repeats", "uneven", "their_repeats"), sharable("their_extra", "their_repeats", "their_uneven", "repeats"))
    shared = F.least(marked, F.least("missing", "their_missing") + beyond)
    overlap = F.col("leader_size") - F.col("missing") - F.col("their_missing") + shared
    small, large = F.least("size", "their_size"), F.greatest("size", "their_size")
    unlike = F.col("uneven") + F.col("their_uneven") + F.least("repeats", "their_repeats")
    reach = ((1 + t) * overlap + unlike * (large / small - t) >= t * (small + large) - 1e-6) & (overlap >= t * small - 1e-6)
    wanted = reach & (F.col("label") != F.col("their_label")) & (F.col("far") | F.col("their_far"))
    odd = _meet(each.where("odd"), each, ["leader"], wanted & (~F.col("their_odd") | (F.col("id") < F.col("their_id"))))
    again = each.where("not odd and repeats > 0")
    return odd.union(_meet(again, again, ["leader"], wanted & (F.col("id") < F.col("their_id"))))


def _components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of links (a, b): the smallest id it is connected with. Labels travel along links and
    then follow their own label, so chains shorten by half each round."""
    both = stage_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links", shrink=16)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label"))
    labels = stage_table(labels, "near-labels", shrink=16)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, "new").select("id", "label", F.least("new", "far").alias("new"))
        step = stage_table(step, "near-labels", shrink=16)
        changed = step.where("new <> label").limit(1).count()
        labels = step.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def _normalised(text_col: str):
    return F.trim(F.regexp_replace(F.lower(text_of(text_col)), r"[^\p{L}\p{N}]+", " "))


def text_key(text_col: str = "text"):
    """MD5 of the words: what tells different texts apart."""
    return F.unhex(F.md5(_normalised(text_col)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), class_size (rows of the class),
    n_texts (different texts of the class), kept (the one row of the class that stays) and text_key.

    Texts are compared as words: lower-case runs of letters and digits. Rows of the same words are one text from the
    start, by MD5; different texts are linked when their probability Jaccard similarity over weighted five-word shingles
    is at least the threshold. Classes are the connected components of the links.

    Candidates are texts that share a band of the signature. Each bucket has a leader, the member that meets most others
    over all its buckets, as the original of a family of copies does. Every member is compared in full with the leaders
    of its buckets: a leader's text goes to the members by tasks of so many members, each member's text to its leaders.
    Members of a bucket that are then still of different classes are judged by their differences from the leader they
    have in common, without their texts: by_differences and by_sizes leave out only pairs that can't reach the
    threshold, and what they find is compared exactly. So pairs grow with the members, no bucket is cut off, and the
    pairs within a class are never listed.

    A text of one to four words has one shingle. Texts without words (also null) form one class, as equal texts. Null
    ids are larger than all others; a class of null ids alone has class_id null. Rows repeated with the same id and
    text: one stays. Empty input gives no rows. Extra columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), _normalised(text_col).alias("norm"))
    base = base.select("doc_id", F.unhex(F.md5("norm")).alias("key"), "norm")
    numbered = base.withColumn("uid", F.monotonically_increasing_id())  # written once, so that repeated rows differ
    sketches = numbered.mapInArrow(sketcher(bands, rows, width), "doc_id long, key binary, uid long, bands array<long>")
    sketches = stage_table(sketches, "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    texts = sketches.groupBy("key").agg(first.alias("first"), F.count(F.lit(1)).alias("n_rows"), F.first("bands").alias("bands"))
    texts = stage_table(texts.withColumn("id", F.col("first.uid")), "near-texts")
    labels = _labels(base, texts, width, threshold)
    named = texts.select("key", "id", "first", "n_rows")
    if labels is not None:
        named = named.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        classes = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("n_rows").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
        named = named.select("key", "label").join(classes, "label").select("key", "first", "class_size", "n_texts")
    else:
        named = named.select("key", "first", F.col("n_rows").alias("class_size"), F.lit(1).cast("long").alias("n_texts"))
    named = stage_table(named, "near-classes", shrink=4)
    out = sketches.select("doc_id", "key", "uid").join(named, "key")
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_texts", (F.col("uid") == F.col("first.uid")).alias("kept"), F.col("key").alias("text_key"))


def _labels(base: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame | None:
    """(id, label) of the texts that are linked with others, or None where no two texts share a bucket."""
    members = texts.select("id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage_table(members.join(shared, "bucket"), "near-members", shrink=4)
    if members.isEmpty():
        return None
    meets = stage_table(members.groupBy("id").agg(F.sum("n").alias("meets")), "near-meets", shrink=4)
    heads = members.join(meets, "id").groupBy("bucket").agg(F.max(F.struct("meets", "id")).alias("lead"))
    heads = stage_table(heads.select("bucket", F.col("lead.id").alias("leader")), "near-heads", shrink=4)
    met = members.select("bucket", "id").join(heads, "bucket").where("id <> leader")
    pairs = stage_table(met.select("id", "leader").distinct(), "near-pairs", shrink=4)
    compared = _with_leaders(base, texts, pairs, width)
    links = compared.where(F.col("similarity") >= threshold - 1e-12).select(F.col("id").alias("a"), F.col("leader").alias("b"))
    labels = _components(links)

    rel = compared.drop("similarity").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    theirs = labels.select(F.col("id").alias("leader"), F.col("label").alias("leader_label"))
    rel = rel.join(theirs, "leader", "left").withColumn("far", F.col("label") != F.coalesce("leader_label", "leader"))
    several = rel.groupBy("leader").agg(F.max("far").alias("open"), F.count(F.lit(1)).alias("n")).where("open and n > 1").select("leader")
    rel = stage_table(rel.drop("leader_label").join(several, "leader"), "near-open")
    found = by_differences(rel, threshold).union(by_sizes(rel, threshold))
    found = stage_table(found.distinct(), "near-found", shrink=8)
    if found.isEmpty():
        return labels
    sides = rel.select("leader", "id", "leader_size", "hash", "own", "theirs")
    full = found.join(sides, ["leader", "id"]).join(sides.drop("leader_size").toDF("leader", "their_id", "their_hash", "their_own", "their_theirs"), ["leader", "their_id"])
    full = full.select("id", "their_id", "leader_size", "hash", "own", "theirs", "their_hash", "their_own", "their_theirs")
    more = stage_table(full.mapInArrow(member_verifier(), "a long, b long, similarity double"), "near-verified", shrink=8)
    more = more.where(F.col("similarity") >= threshold - 1e-12).select("a", "b")
    return labels if more.isEmpty() else _components(links.union(more))


def _with_leaders(base: DataFrame, texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Each pair (id, leader) compared in full. A leader's members are dealt into tasks of FAMILY members, and the
    leader's text goes to each of them once."""
    family = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("tasks"))
    family = stage_table(family, "near-families", shrink=4)
    to_members = pairs.join(family, "leader").select("leader", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("role"), "id")
    to_leaders = family.select("leader", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("role"), F.col("leader").alias("id"))
    at = texts.select("id", F.col("key").alias("of"), F.col("first.doc_id").alias("at_id"))
    routes = stage_table(to_members.union(to_leaders).join(at, "id"), "near-routes", shrink=4)
    # A hash or broadcast join would do for few routes only; sorted, the plan is the same at every size.
    dealt = base.join(routes.hint("merge"), (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("at_id")))
    dealt = dealt.select("leader", "task", "role", "id", "norm").repartition("leader", "task")
    dealt = dealt.sortWithinPartitions("leader", "task", "role", "id").select("leader", "role", "id", "norm")
    return stage_table(dealt.mapInArrow(comparer(width), _COMPARED), "near-compared")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class, all columns as they were. Cases as in near_duplicates."""
    found = stage_table(near_duplicates(docs, id_col, text_col, **options), "near-kept")
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("at_id"), text_key(text_col).alias("at_key"))
    out = rows.join(kept, F.col("at_id").eqNullSafe(F.col("kept_id")) & (F.col("at_key") == F.col("kept_key")), "left_semi")
    again = found.where("not kept").join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    if not again.isEmpty():  # rows that repeat both the id and the text of one that stays
        out = out.dropDuplicates(["at_id", "at_key"])
    return out.select("row.*")


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key")
