"""N-gram Jaccard join by signature trees.

Documents whose sets of word shingles have a Jaccard similarity of at least 3/4 are linked;
each document gets the smallest doc_id that it reaches by links.

1. One pass makes every document's shingle set, its digest and its MinHash band keys.
   Equal sets are one class from here on; only the class's smallest doc_id goes on.
2. Every class of a bucket (equal keys of one band) is linked with the bucket's smallest class;
   linked classes form families. So two classes with any common band are in one family, whatever
   else is in their buckets. With 120 bands of 7, a pair at similarity 3/4 has no common band with
   probability 3.4e-8; bands of 7 keep texts that only share passages mostly apart (a pair at
   similarity 0.2 has a common band with probability 0.002).
3. Within a family a signature tree decides exactly. Blocks of at most about ``BLOCK`` texts of
   like size are the subtrees; each block, with the family's pivot, is joined with itself.
   Tree nodes hold the OR of their members' shingle bitmaps, the range of set sizes and the
   largest count of shingles that share a bit. Dual traversal drops a pair of nodes when
   sizes or the greatest possible overlap rule out a link, or when both are known to be in
   one component; leaves compare whole sets.
4. What is left are pairs of classes with a common bucket that stand in different blocks and
   different components; at least one of the two is outside its family's largest component. So in
   families with several blocks and components, classes outside are cut into blocks of their own, which are joined with each
   other and with all the rest. Where that costs more than looking through the family's buckets once more, as in families
   that chance collisions have strung together, the same is done bucket by bucket: only buckets with several blocks
   and components, buckets of equal members once. Both leave out no pair that may still matter.

Shingles are compared as 64-bit hashes (words beyond 64 bytes by BLAKE2b), sets of equal digest
(128 bits) as equal.

Nulls: a null text is empty; empty texts link with nothing. A row without doc_id keeps a
null component. Rows that repeat a doc_id are one node, linked with whatever any of their texts is. Extra columns are
ignored, whatever their names. Very long texts are hashed in pieces (8 bytes a word stay). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trunkline.llm.common import ByteHasher, connected_components, documents, grouped_frames, lean, mix64, packed_texts, quoted, shingle_sets, small_batches, stored, unpacked

SHINGLE_WORDS = 5
BANDS, ROWS = 120, 7
BLOCK = 128
SKETCH = "doc_id long, n_shingles long, digest binary, bands array<long>"


def minhash_bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys, one line per set; an empty set gets zeros."""
    count = bands * rows
    seeds = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64))
    mul, add = (seeds[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds[count:].astype(np.uint32)
    sig = np.zeros((len(sets), count), dtype=np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        if len(x):
            best = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
            for lo in range(0, len(x), 1024):
                best = np.minimum(best, (mul[:, None] * x[None, lo : lo + 1024] + add[:, None]).min(axis=1))
            sig[i] = best
    acc = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sets), bands)).copy()
    parts = sig.reshape(len(sets), bands, rows).astype(np.uint64)
    for r in range(rows):
        acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return acc.view(np.int64)


def sketches(docs: DataFrame, words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHasher()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = list(shingle_sets(part.column(1), hasher, words))
                keys = minhash_bands(sets, bands, rows)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32), pa.array(keys.ravel(), pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SKETCH)


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


class _Node:
    __slots__ = ("bits", "children", "excess", "items", "large", "small")

    def __init__(self, items, children, bits, excess, small, large) -> None:
        self.items, self.children, self.bits, self.excess, self.small, self.large = items, children, bits, excess, small, large


def build_tree(sets: list[np.ndarray], order: list[int], width: int, leaf: int = 4, fan: int = 4) -> _Node:
    """Signature tree over ``order`` (ascending sizes): OR of ``width``-bit maps, size range, most shingles beyond one a bit."""
    level = []
    for lo in range(0, len(order), leaf):
        items = order[lo : lo + leaf]
        bits = excess = 0
        for i in items:
            spread = np.zeros(width, dtype=bool)
            spread[(sets[i] & np.uint64(width - 1)).astype(np.int64)] = True
            own = int.from_bytes(np.packbits(spread).tobytes(), "big")
            bits |= own
            excess = max(excess, len(sets[i]) - own.bit_count())
        level.append(_Node(items, [], bits, excess, len(sets[items[0]]), len(sets[items[-1]])))
    while len(level) > 1:
        above = []
        for lo in range(0, len(level), fan):
            kids = level[lo : lo + fan]
            bits = 0
            for k in kids:
                bits |= k.bits
            above.append(_Node([i for k in kids for i in k.items], kids, bits, max(k.excess for k in kids), kids[0].small, kids[-1].large))
        level = above
    return level[0]


def tree_links(sets: list[np.ndarray], left: list[int], right: list[int] | None, known: list[int]) -> list[tuple[int, int]]:
    """Links that join different components: members of ``left`` among themselves, or with ``right``.

    ``known`` gives each item's component so far; pairs within one component are never compared.
    A link has 100 * overlap >= 75 * union, that is 7 * overlap >= 3 * (sum of sizes). The
    overlap is at most the bits that both maps share plus the smaller excess.
    """
    forest = _Forest(len(sets))
    first: dict[int, int] = {}
    for i, c in enumerate(known):
        forest.join(i, first.setdefault(c, i))
    groups = [sorted((i for i in g if len(sets[i])), key=lambda i: len(sets[i])) for g in ([left] if right is None else [left, right])]
    if not all(groups):
        return []
    width = 256
    while width < 4 * max(len(sets[i]) for g in groups for i in g):
        width *= 2
    tops = [build_tree(sets, g, width) for g in groups]
    plain: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in plain:
            plain[i] = frozenset(sets[i].tolist())
        return plain[i]

    found = []
    stack = [(tops[0], tops[-1])]
    while stack:
        x, y = stack.pop()
        if 4 * x.large < 3 * y.small or 4 * y.large < 3 * x.small:
            continue
        if x is not y and 7 * ((x.bits & y.bits).bit_count() + min(x.excess, y.excess)) < 3 * (x.small + y.small):
            continue
        roots = {forest.root(i) for i in x.items}
        if len(roots) == 1 and all(forest.root(i) in roots for i in y.items):
            continue
        if x is y and x.children:
            kids = x.children
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif x.children and (not y.children or len(x.items) >= len(y.items)):
            stack += [(k, y) for k in x.children]
        elif y.children:
            stack += [(x, k) for k in y.children]
        else:
            for i in x.items:
                for j in y.items:
                    m, n = len(sets[i]), len(sets[j])
                    if (x is y and i >= j) or forest.root(i) == forest.root(j) or 4 * min(m, n) < 3 * max(m, n):
                        continue
                    if 7 * len(members(i) & members(j)) >= 3 * (m + n):
                        forest.join(i, j)
                        found.append((i, j))
    return found


def _block_links(rows: DataFrame, words: int) -> DataFrame:
    """Links (a, b) within each ``task``: side 0 with itself, or side 0 with side 1 where there is one.

    rows: task string, side int, rep long, component long, packed binary; a task holds a block or two.
    """

    def run(batches):
        hasher = ByteHasher()
        out = []
        for group in grouped_frames((b.to_pandas() for b in batches), ["task"]):
            sets = [s for _, _, texts in unpacked(pa.array(group["packed"].tolist(), pa.binary())) for s in shingle_sets(texts, hasher, words)]
            ids, side = group["rep"].tolist(), group["side"].tolist()
            left = [i for i, s in enumerate(side) if s == 0]
            right = [i for i, s in enumerate(side) if s == 1]
            out += [(ids[i], ids[j]) for i, j in tree_links(sets, left, right or None, group["component"].tolist())]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.select("task", "side", "rep", "component", "packed").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(lean(run), "a long, b long")


def _cut_and_paired(members: DataFrame) -> DataFrame:
    """(task, side, rep, component) of groups: members (group, rep, component, n_shingles, odd).

    A group of ``BLOCK`` members at most is one task. Larger ones are cut by ``odd``, size and hash; the odd
    parts meet each other, themselves and the rest, as far as sizes allow a link.
    """
    band = F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3))).cast("long")
    members = stored(members.withColumn("band", band), "jaccard-members")
    share = members.groupBy("group", "odd", "band").agg(F.count("*").alias("m"))
    whole = share.groupBy("group").agg(F.sum("m").alias("n"))
    few = members.join(whole.where(F.col("n") <= BLOCK).select("group"), "group", "left_semi").select(F.col("group").alias("task"), F.lit(0).alias("side"), "rep", "component")
    large = share.join(whole.where(F.col("n") > BLOCK).select("group"), "group", "left_semi").select("group", "odd", "band", F.ceil(F.col("m") / BLOCK).alias("cuts"))
    part = F.concat_ws(":", "group", F.col("odd").cast("int"), "band", F.pmod(F.xxhash64("rep"), F.col("cuts")))
    many = stored(members.join(large, ["group", "odd", "band"]).select("group", "odd", part.alias("part"), "rep", "component", "n_shingles"), "jaccard-parts")
    parts = many.groupBy("group", "odd", "part").agg(F.min("n_shingles").alias("small"), F.max("n_shingles").alias("large"), (F.min("component") != F.max("component")).alias("mixed"))
    x, y = parts.where("odd").alias("x"), parts.alias("y")
    pair = (F.col("y.odd") & (F.col("x.part") < F.col("y.part"))) | ~F.col("y.odd") | ((F.col("x.part") == F.col("y.part")) & F.col("x.mixed"))
    near = (4 * F.col("x.large") >= 3 * F.col("y.small")) & (4 * F.col("y.large") >= 3 * F.col("x.small"))
    pairs = x.join(y, "group").where(pair & near).select(F.concat_ws("|", "x.part", "y.part").alias("task"), F.col("x.part").alias("one"), F.col("y.part").alias("two"))
    side = lambda i, c: F.struct(F.lit(i).alias("side"), F.col(c).alias("part"))
    sides = F.when(F.col("one") == F.col("two"), F.array(side(0, "one"))).otherwise(F.array(side(0, "one"), side(1, "two")))
    dealt = pairs.select("task", F.explode(sides).alias("s")).select("task", "s.side", "s.part")
    return few.unionByName(dealt.join(many.select("part", "rep", "component"), "part").select("task", "side", "rep", "component"))


def _cost(n: F.Column, odd: F.Column) -> F.Column:
    """About how many texts the tasks of a group take."""
    blocks = lambda c: F.ceil(c / BLOCK)
    return F.when(n <= BLOCK, n.cast("double")).otherwise(2.0 * BLOCK * blocks(odd) * (blocks(odd) / 2 + blocks(n - odd)))


def _unsettled(first: DataFrame, state: DataFrame) -> DataFrame | None:
    """(task, side, rep, component) of what step 4 compares; None if all is settled."""
    several = lambda c: F.min(c) != F.max(c)
    open_ = state.groupBy("family").agg(several("component").alias("c"), several("block").alias("b")).where("c and b").select("family")
    loose = stored(state.join(open_, "family", "left_semi").select("family", "rep", "block", "component", "n_shingles"), "jaccard-loose")
    if not loose.limit(1).count():
        return None
    sizes = loose.groupBy("family", "component").agg(F.count("*").alias("m"))
    families = sizes.groupBy("family").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("component", F.struct("m", -F.col("component"))).alias("head"))
    families = families.select("family", "head", _cost(F.col("n"), F.col("n") - F.col("most")).alias("cost"))
    members = stored(loose.join(families, "family").withColumn("odd", F.col("component") != F.col("head")), "jaccard-odd")

    held = first.select("rep", "bands").join(members, "rep").select("family", "cost", "rep", "block", "component", "n_shingles", "odd", F.explode("bands").alias("key"))
    held = stored(held, "jaccard-held")
    buckets = held.groupBy("key").agg(
        F.count("*").alias("n"), F.count_if("odd").alias("odds"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min("family").alias("family"),
        F.min("cost").alias("cost"), F.min("n_shingles").alias("small"), F.max("n_shingles").alias("large"), several("component").alias("c"), several("block").alias("b"),
    )
    buckets = buckets.where("c and b").where((F.col("n") > 2) | (4 * F.col("small") >= 3 * F.col("large")))
    once = stored(buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.min("odds").alias("odds"), F.min("family").alias("family"), F.min("cost").alias("cost")), "jaccard-buckets")
    by_bucket = once.groupBy("family").agg(F.sum(_cost(F.col("n"), F.col("odds"))).alias("total"), F.min("cost").alias("cost"))
    whole = stored(by_bucket.where(F.col("cost") < F.col("total")).select("family"), "jaccard-whole")
    as_families = members.join(whole, "family", "left_semi").select(F.concat(F.lit("f"), "family").alias("group"), "rep", "component", "n_shingles", "odd")
    keys = once.join(whole, "family", "left_anti").select("key")
    as_buckets = held.join(keys, "key").select(F.concat(F.lit("b"), "key").alias("group"), "rep", "component", "n_shingles", "odd")
    return _cut_and_paired(as_families.unionByName(as_buckets))


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...)."""
    small_batches(docs.sparkSession)
    sketch = stored(sketches(docs, words), "jaccard-sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    first = full.join(classes.hint("merge"), (full.digest == classes.digest) & (full.doc_id == classes.rep))
    first = stored(first.select("rep", "n_shingles", "bands"), "jaccard-first")
    keys = first.select("rep", F.explode("bands").alias("key"))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    candidates = (
        keys.join(pivots.hint("merge"), "key").where("rep <> pivot")
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    )
    families = stored(connected_components(candidates, "jaccard-family").select(F.col("id").alias("rep"), F.col("label").alias("family")), "jaccard-families")

    sized = families.join(first.select("rep", "n_shingles"), "rep").withColumn("band", F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3))).cast("long"))
    share = sized.groupBy("family", "band").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocked = sized.join(share, ["family", "band"]).withColumn("block", F.concat_ws(":", "family", "band", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    blocked = stored(blocked.select("rep", "family", "n_shingles", "block"), "jaccard-blocks")
    texts = packed_texts(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"))
    placed = stored(blocked.hint("merge").join(texts, "rep"), "jaccard-texts")

    own = placed.select(F.col("block").alias("task"), F.lit(0).alias("side"), "rep", F.col("rep").alias("component"), "packed")
    heads = placed.where("rep = family").select("family", F.col("block").alias("home"), "rep", "packed")
    others = blocked.select("family", "block").distinct().join(heads, "family").where("block <> home")
    pivot = others.select(F.col("block").alias("task"), F.lit(0).alias("side"), "rep", F.col("rep").alias("component"), "packed")
    links = stored(_block_links(own.unionByName(pivot), words), "jaccard-links")

    labels = connected_components(links, "jaccard-inner")
    state = stored(
        blocked.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "family", "n_shingles", "block", F.coalesce("label", "rep").alias("component")),
        "jaccard-state",
    )
    tasks = _unsettled(first, state)
    if tasks is not None:
        across = tasks.join(placed.select("rep", "packed"), "rep").select("task", "side", "rep", "component", "packed")
        labels = connected_components(links.union(_block_links(across, words)), "jaccard-all")
    final = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(final.hint("merge"), "digest", "left")
    own_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own_id).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS label FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id AND r.label < e.b),
c AS (SELECT id, min(label) AS label FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.label, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each component; rows without doc_id stay, and all rows that repeat the kept doc_id."""
    kept = stored(jaccard_components(docs), "jaccard-kept").where("doc_id = component_id").select("doc_id").distinct()
    whole = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*[quoted(c) for c in docs.columns])
    return whole.unionByName(docs.where("doc_id is null"))
