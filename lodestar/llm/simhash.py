"""SimHash near-duplicates (operator 10) by the May-Ozerov nearest-neighbour recursion.

128-bit SimHashes of five-word shingles are the vectors. On a strip of 32 coordinates a vector enters the list of each
random centre to which its partial weight (its distance on the strip) is small; two near vectors share a list far more
often than two others. Lists still too long recurse on the next strip; short ones are compared by brute force. So many
centres are drawn that a pair at the similarity asked for shares a list with the target recall. Candidates joined by
small distances are then verified by the Jaccard similarity of their whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _run, suffix_dedup
from . import _text as T

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.95
BITS, STRIP, STRIPS = 128, 32, 4
#: Partial weight on a strip up to which a vector enters a centre's list.
WEIGHT = 7
#: Vectors that one task compares by brute force. Longer lists are compared part against part; those of over DIVIDE
#: times as many recurse while there are strips, since below that all pairs cost less than a further strip's centres.
LIST_ROWS, DIVIDE = 4096, 32
#: Each level's share of the recall (as a power of it), so that their product is the recall at the last level.
LEVEL_SHARES = (0.4, 0.4, 0.1, 0.1)
#: Distinct texts of a candidate component that one task verifies at once, and those of a cluster that first stand for
#: it towards the other parts of a larger component.
VERIFY_ROWS, LEADERS = 2048, 32

#: Links that one task joins while components are found.
EDGE_ROWS = 50_000

_SIGNS = np.where((np.arange(256)[:, None] >> np.arange(8)) & 1, 1, -1).astype(np.float32)


def expected_distance(similarity: float) -> float:
    """Share of differing bits of two sets of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def centres_for(recall: float, similarity: float, strips: int = 1, weight: int = WEIGHT, strip: int = STRIP) -> int:
    """How many centres, dealt over so many strips, give a pair of this similarity a common list with this probability.

    The differing bits of a strip vary from pair to pair, so the chance to miss is a mean over their number.
    """
    share, cases = expected_distance(similarity), []
    for f in range(strip + 1):
        both = sum(math.comb(f, i) * math.comb(strip - f, j) for i in range(f + 1) for j in range(strip - f + 1) if i + j <= weight and f - i + j <= weight) / 2**strip
        cases.append((math.comb(strip, f) * share**f * (1 - share) ** (strip - f), both))
    low, high = 1, 1 << 24
    while low < high:
        n = (low + high) // 2
        miss = sum(at * math.exp(-both * n / strips) for at, both in cases) ** strips
        low, high = (low, n) if 1 - miss >= recall else (n + 1, high)
    return low


def level_centres(recall: float, similarity: float) -> list[int]:
    """How many centres each level draws, so that a pair that passes all of them keeps this probability to be found."""
    return [centres_for(recall**share, similarity, STRIPS if level == 0 else 1) for level, share in enumerate(LEVEL_SHARES)]


def largest_distance(similarity: float, bits: int = BITS) -> int:
    """The expected distance plus three standard deviations."""
    p = expected_distance(similarity)
    return math.floor(bits * p + 3.1 * math.sqrt(bits * p * (1 - p)))


def shingles(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than five words is one shingle of all."""
    text, start, end = T.words(data, offsets)
    hashes = T.Hasher(data).of(start, end)
    first = np.searchsorted(text, np.arange(len(offsets)))
    keys, at = T.grams(hashes, text, WORDS)
    of_gram = np.searchsorted(text[at], np.arange(len(offsets))) if len(at) else np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        if first[i + 1] - first[i] >= WORDS:
            yield np.unique(keys[of_gram[i] : of_gram[i + 1]])
        elif first[i + 1] > first[i]:
            x = np.uint64(0)
            for h in hashes[first[i] : first[i + 1]]:
                x = x * np.uint64(0xD6E8FEB86659FD93) + h
            yield T.mix(np.asarray([x]))
        else:
            yield np.empty(0, np.uint64)


def fingerprint(sets: np.ndarray) -> bytes:
    both = np.stack([T.mix(sets + np.uint64(0x9E3779B97F4A7C15)), T.mix(sets ^ np.uint64(0xC2B2AE3D27D4EB4F))], axis=1)
    found = np.bincount((both.view(np.uint8).reshape(len(sets), 16) + (np.arange(16) << 8)).ravel(), minlength=4096).reshape(16, 256)
    return np.packbits(found.astype(np.float32) @ _SIGNS > 0, axis=1, bitorder="little").tobytes()


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, th, fp) for each row: the MD5 of the text (equal texts) and its SimHash, null for texts without words."""
    kind = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for begin, stop, data, offsets in T.blocks(batch.column(2)):
                    out = [fingerprint(s) if len(s) else None for s in shingles(data, offsets)]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin:stop], batch.column(1)[begin:stop], pa.array(out, pa.binary())], names=["doc_id", "th", "fp"])

    return df.select(F.col(id_column), F.unhex(F.md5(_run.utf8(text_column))).alias("th"), F.col(text_column)).mapInArrow(run, f"doc_id {kind}, th binary, fp binary")


def _packed(column: pa.Array) -> np.ndarray:
    """(n, 4) strips of a binary column of 16 bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, STRIPS)


def _lists(level: int, centres: int, seed: int):
    """(list, fp) → a row for each list of this level that the vector enters. Level 0 takes every strip in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = range(STRIPS) if level == 0 else [level]
        drawn = {s: np.random.default_rng([seed, level, s]).integers(0, 2**STRIP, -(-centres // len(strips)), dtype=np.uint32) for s in strips}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x, parent = _packed(part.column(1)), part.column(0).to_numpy().view(np.uint64)
                who, key = [], []
                for s, z in drawn.items():
                    i, j = np.nonzero(np.bitwise_count(x[:, s, None] ^ z) <= WEIGHT)
                    who.append(i)
                    key.append(T.mix(parent[i] + np.uint64(0x9E3779B97F4A7C15) * (j.astype(np.uint64) + np.uint64(1 + s * centres))))
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), part.column(1).take(pa.array(who))], names=["list", "fp"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with one value of the first column, from batches sorted by it."""
    open_parts: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = table.slice(a, b - a)
            if open_parts and open_parts[0].column(0)[0] != part.column(0)[0]:
                yield pa.concat_tables(open_parts)
                open_parts = []
            open_parts.append(part)
    if open_parts:
        yield pa.concat_tables(open_parts)


def _near(radius: int):
    """Brute force in each list: links between near vectors, all of them or, where they are dense, a star in each clump.

    Where rows have sides 1 and 2, only pairs of one of each are compared; without sides (0), all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for group in _groups(batches):
            n = len(group)
            if n < 2:
                continue
            names = group.column(1).to_pylist()
            low, high = np.ascontiguousarray(np.frombuffer(b"".join(names), "<u8").reshape(-1, 2).T)
            side = group.column(2).to_numpy()
            one, two = (np.flatnonzero(side < 2), np.flatnonzero(side != 1))
            near = [np.empty((2, 0), np.int64)]
            for a in range(0, len(one), 512):
                p = one[a : a + 512]
                for b in range(a if len(one) == n else 0, len(two), 512):  # squares that stay in the cache
                    q = two[b : b + 512]
                    d = np.bitwise_count(low[p, None] ^ low[q])
                    d += np.bitwise_count(high[p, None] ^ high[q])
                    at = np.flatnonzero(d.ravel() <= radius)
                    i, j = p[at // len(q)], q[at % len(q)]
                    keep = i < j if len(one) == n else slice(None)
                    near.append(np.stack([i[keep], j[keep]]))
            i, j = np.concatenate(near, axis=1)
            if len(i) > 2 * n:  # a star spans what these links connect
                label = np.arange(n)
                while True:
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    np.minimum.at(low, j, label[i])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                i, j = label, np.arange(n)
                i, j = i[i != j], j[i != j]
            left += [names[k] for k in i]
            right += [names[k] for k in j]
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return run


def _blocks(lists: DataFrame, long: DataFrame, list_rows: int) -> DataFrame:
    """(list, fp, side): lists as they are, but long ones (list, count) as their parts and all pairs of these.

    Parts hold half ``list_rows`` each. Of a pair of parts only the pairs between them are compared.
    """
    dealt = lists.join(long, "list", "left").withColumn("parts", F.ceil(2 * F.col("count") / list_rows).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp", "list"), "parts"))
    whole = dealt.filter("parts is null").select("list", "fp", F.lit(0).alias("side"))
    pairs = dealt.filter("parts is not null").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return whole.unionByName(pairs.select(F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other")).alias("list"), "fp", side.alias("side")))


def near_links(vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, list_rows: int = LIST_ROWS, seed: int = 5, divide: int = DIVIDE) -> DataFrame:
    """Links (a, b) between distinct 128-bit vectors (column fp): a set that spans the near pairs found.

    All pairs of a list are compared, whatever its length.
    """
    radius = largest_distance(similarity)
    lists = vectors.select(F.lit(0).cast("long").alias("list"), "fp")
    links = None
    for level, centres in enumerate(level_centres(recall, similarity)):
        lists = lists.mapInArrow(_lists(level, centres, seed), "list long, fp binary")
        if vectors.count() <= list_rows:
            short, long = lists.withColumn("side", F.lit(0)), None
        else:
            lists = _run.cut(lists)
            long_ones = _run.cut(lists.groupBy("list").count().filter(F.col("count") > list_rows))
            if long_ones.isEmpty():
                short, long = lists.withColumn("side", F.lit(0)), None
            else:
                further = long_ones.filter(F.col("count") > (list_rows * divide if level < STRIPS - 1 else 1 << 62)).select("list")
                short = _blocks(lists.join(further, "list", "left_anti"), long_ones, list_rows)
                long = None if further.isEmpty() else lists.join(further, "list", "left_semi")
        found = short.repartition("list").sortWithinPartitions("list", "fp").mapInArrow(_near(radius), "a binary, b binary")
        links = found if links is None else links.unionByName(found)
        if long is None:
            break
        lists = long
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component.

    Each round every node moves along smallest neighbours as far as they lead, and links are drawn between what the
    nodes moved to; links inside one of these vanish, so that a star of any size is gone after one round. Tasks take some
    ``EDGE_ROWS`` links each, however many partitions the session gives an exchange.

    Each step is a table, not a checkpoint: a checkpoint inherits the size that the plan estimates, the product of both
    sides for a join, so the digits of that number double with each step until the driver has no room and time for it.
    """
    edges = _run.cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct())
    tasks = max(1, -(-edges.count() // EDGE_ROWS))
    edges = edges.coalesce(tasks)

    made: list[tuple[DataFrame, Callable[[], None]]] = []

    def cut(df: DataFrame) -> DataFrame:
        made.append(_run.stored(df.coalesce(tasks)))
        return made[-1][0]

    labels = last = None
    for _ in range(rounds):
        if labels is not None and edges.isEmpty():
            for table, drop in made:
                if table is not last:
                    drop()
            return labels
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        near = cut(near)
        while True:  # pointers double their reach, so that a chain takes logarithmically many steps
            jump = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
            whole = cut(near.join(jump, "to").select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            near = whole.select("node", "to")
            if whole.filter("moved").isEmpty():
                break
        left, right = near.toDF("a", "x"), near.toDF("b", "y")
        moved = edges.join(left, "a").join(right, "b").filter("x != y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        # What earlier rounds gave moves along.
        if labels is None:
            labels, last = near.toDF("node", "label"), whole
        else:
            labels = last = cut(labels.join(near.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
    raise RuntimeError("components did not settle")


def cluster(sets: list[np.ndarray], similarity: float = SIMILARITY, known: list | None = None, side: list | None = None) -> np.ndarray:
    """Classes of the graph of all pairs with at least this Jaccard similarity, each named by its first member.

    Members of one class need no further comparison; those that stand nearest the front are tried first. ``known`` names
    classes found before; members of one ``side`` have been compared with each other before.
    """
    n, first = len(sets), {}
    label = np.arange(n) if known is None else np.asarray([first.setdefault(k, i) for i, k in enumerate(known)], np.int64)
    sides = None if side is None else np.asarray(side)
    sizes = np.asarray([len(s) for s in sets], np.int64)
    begins = np.cumsum(sizes) - sizes
    names, codes = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    mark = np.zeros(len(names), bool)
    for i in range(1, n):
        may = (label[:i] != label[i]) & (np.minimum(sizes[:i], sizes[i]) >= similarity * np.maximum(sizes[:i], sizes[i]) - 1e-9)
        left = np.flatnonzero(may if sides is None else may & (sides[:i] != sides[i]))
        if not len(left):
            continue
        mine = codes[begins[i] : begins[i] + sizes[i]]
        mark[mine] = True
        step = 8
        while len(left):
            step = max(1, int(np.searchsorted(np.cumsum(sizes[left[:step]]), 1 << 18, "right")))
            at, left = left[:step], left[step:]
            step *= 4
            stop = np.cumsum(sizes[at])
            found = mark[codes[np.repeat(begins[at] - stop + sizes[at], sizes[at]) + np.arange(stop[-1])]]
            run = np.concatenate([[0], np.cumsum(found)])
            both = run[stop] - run[stop - sizes[at]]
            for j in at[both >= similarity * (sizes[i] + sizes[at] - both) - 1e-9]:
                a, b = sorted((label[i], label[j]))
                if a != b:
                    label[label == b] = a
            left = left[label[left] != label[i]]
        mark[mine] = False
    return label


def _verify(similarity: float, leaders: int):
    """(comp, th, grams) → (comp, th, head, leads, grams): each text's verified cluster in this part; grams of leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            th = group.column("th").to_pylist()
            raw = group.column("grams").to_pylist()
            order = sorted(range(len(th)), key=lambda i: th[i])
            label = cluster([np.frombuffer(raw[i], np.uint64) for i in order], similarity)
            count: dict[int, int] = {}
            heads, grams = [], []
            for k, i in enumerate(order):
                at = int(label[k])
                count[at] = count.get(at, 0) + 1
                heads.append(th[order[at]])
                grams.append(raw[i] if count[at] <= leaders else None)
            t = group.select(["comp"]).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().cast(pa.binary()), pa.array([th[i] for i in order], pa.binary()), pa.array(heads, pa.binary()), pa.array(grams, pa.binary())], names=["comp", "th", "head", "grams"])

    return run


def _meet(similarity: float):
    """(block, part, head, grams) → (a, b): heads of clusters that a pair of texts of the block's two parts links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            head = group.column("head").to_pylist()
            label = cluster([np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()], similarity, head, group.column("part").to_pylist())
            links = sorted({(h, head[k]) for h, k in zip(head, label.tolist(), strict=True) if h != head[k]})
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], names=["a", "b"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for begin, stop, data, offsets in T.blocks(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:stop], batch.column(1)[begin:stop], pa.array([s.tobytes() for s in shingles(data, offsets)], pa.binary())], names=["comp", "th", "grams"])


def _crossing(texts: DataFrame, similarity: float) -> DataFrame:
    """Of texts (th, grams, comp, part, head) those that a link may join to another cluster of their component.

    Two texts of a link share at least ``similarity`` of the shingles of each. So a text goes where fewer of its shingles
    are found in two clusters of its component, and what it shared goes with it: the rest is looked at again while it
    shrinks. Shingles meet as partial sums, and texts meet a filter of bounded size, which may only let more of them pass.
    """

    def told(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each shingle, which is told by its component."""
        sets = [np.frombuffer(g, np.uint64) for g in batch.column(2).to_pylist()]
        who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        return who, T.mix(np.concatenate([*sets, np.empty(0, np.uint64)]) ^ batch.column(0).to_numpy().view(np.uint64)[who])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                who, h = told(part)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column(1).take(pa.array(who))], names=["h", "head"])

    left = texts.count()
    while left:
        slim = texts.select(F.xxhash64("comp").alias("c"), F.xxhash64("head").alias("head"), "grams")
        shared = slim.mapInArrow(spread, "h long, head long").groupBy("h").agg(F.min("head").alias("low"), F.max("head").alias("high")).filter("low != high").select("h")
        shared, drop = _run.stored(shared)
        keep = suffix_dedup._filter(shared, "h")
        drop()

        def passing(batches: Iterator[pa.RecordBatch], keep=keep) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 200):
                    part = batch.slice(at, 200)
                    who, h = told(part)
                    some = next(keep(iter([pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(who)], names=["h", "who"])])))
                    found, size = np.bincount(some.column(1).to_numpy(), minlength=len(part)), np.bincount(who, minlength=len(part))
                    yield part.filter(pa.array((found > 0) & (found >= similarity * size - 1e-9))).select(["th"])

        some = texts.select(F.xxhash64("comp").alias("c"), "th", "grams").mapInArrow(passing, "th binary")
        texts = _run.cut(texts.join(some, "th", "left_semi"))
        before, left = left, texts.count()
        if left > before // 2:
            break
    return texts


def _merged(chain: DataFrame, links: DataFrame) -> DataFrame:
    """(th, head) after links (a, b) between heads."""
    merged = components(links.filter("a != b"))
    return chain.join(merged, chain["head"] == merged["node"], "left").select("th", F.coalesce("label", "head").alias("head"))


def near_classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, verify_rows: int = VERIFY_ROWS, leaders: int = LEADERS, list_rows: int = LIST_ROWS, seed: int = 5) -> DataFrame:
    """One row for each row of ``df``: doc_id, class_id (the smallest doc_id of its class), class_size, th.

    Classes are the connected groups of texts with a Jaccard similarity of at least ``similarity`` on sets of five-word
    shingles; equal texts are of one class. Texts without words (null, empty, blank) are of the class of their equals.
    Null ids are larger than any for class_id; repeated rows are members each; an empty table gives no rows.

    Links are found with the probability ``recall`` at that similarity, and more surely above it. A component of more
    than ``verify_rows`` distinct texts is verified in parts: each whole, then up to ``leaders`` texts of each cluster, and then,
    unless these made it one cluster, each part with each other part on whole sets, except pairs of one cluster and
    texts that share too few shingles with other clusters to have a link to any.
    """
    marks = _run.cut(fingerprints(df, id_column, text_column))
    total = marks.count()
    texts = marks.filter("fp is not null").groupBy("th").agg(F.first("fp").alias("fp"), F.min(F.struct("doc_id")).alias("pick"))
    # Distinct texts, by vector: partial sums first, so copies never meet in one task.
    texts = _run.cut(texts)
    vectors = _run.cut(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    labels = components(near_links(vectors.select("fp"), similarity, recall, list_rows, seed))
    placed = vectors.join(labels, vectors["fp"] == labels["node"], "left").filter("n > 1 or label is not null").select("fp", F.coalesce("label", "fp").alias("comp"))
    members = _run.cut(texts.join(placed, "fp").select("th", "comp", "pick"))
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    # Two parts of a larger component fit a task together.
    parts = F.when(F.col("n") > verify_rows, F.ceil(2 * F.col("n") / verify_rows)).otherwise(1).cast("int")
    parted = _run.cut(members.join(sizes, "comp").select("th", "comp", "pick", F.pmod(F.xxhash64("th"), parts).cast("int").alias("part"), parts.alias("parts")))
    # One row stands for each text: rows meet it by text and id, so copies of a text spread over the tasks.
    given = df.select(F.unhex(F.md5(_run.utf8(text_column))).alias("th"), F.struct(F.col(id_column).alias("doc_id")).alias("pick"), F.col(text_column).alias("text"))
    own = given.join(parted, ["th", "pick"]).dropDuplicates(["th"])
    key = F.when(F.col("parts") > 1, F.concat("comp", F.encode(F.concat(F.lit("#"), F.col("part")), "utf-8"))).otherwise(F.col("comp"))
    sets = own.select(key.alias("comp"), "th", "text").mapInArrow(_grams, "comp binary, th binary, grams binary")
    checked = _run.cut(sets.repartition("comp").sortWithinPartitions("comp").mapInArrow(_verify(similarity, leaders), "comp binary, th binary, head binary, grams binary"))
    chain = checked.select("th", "head")
    if not parted.filter("parts > 1").isEmpty():
        # Leaders of all parts of a component, compared again; clusters that they link become one.
        open_parts = checked.filter(F.col("grams").isNotNull() & (F.length("comp") > 16)).select(F.substring("comp", 1, 16).alias("comp"), "th", "head", "grams")
        # As many of them as a task takes, those of the largest clusters first; the parts' own comparison finds the rest.
        ahead = chain.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
        first = open_parts.select("comp", "th", "head").join(ahead, "head").withColumn("at", F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("size"), "head", "th"))).filter(F.col("at") <= verify_rows)
        open_parts = _run.cut(open_parts.join(first.select("th"), "th", "left_semi"))
        again = open_parts.select("comp", "th", "grams").repartition("comp").sortWithinPartitions("comp").mapInArrow(_verify(similarity, 0), "comp binary, th binary, head binary, grams binary").select(F.col("th").alias("lead"), F.col("head").alias("top"))
        joined = open_parts.select("th", "head").join(again, F.col("th") == F.col("lead")).select(F.col("head").alias("a"), F.col("top").alias("b"))
        chain = _run.cut(_merged(chain, joined))
        # Parts of a component of several clusters, two by two: links of any other members.
        several = parted.filter("parts > 1").join(chain, "th")
        several = several.join(several.groupBy("comp").agg(F.min("head").alias("low"), F.max("head").alias("high")).filter("low != high").select("comp"), "comp", "left_semi")
        several = _run.cut(several.select("th", "pick", "comp", "part", "parts", "head"))
        if not several.isEmpty():
            texts = given.join(several.select("th", "pick"), ["th", "pick"], "left_semi").dropDuplicates(["th"])
            whole = texts.select(F.col("th").alias("comp"), "th", "text").mapInArrow(_grams, "comp binary, th binary, grams binary").select("th", "grams")
            whole = _crossing(_run.cut(whole.join(several.drop("pick"), "th")), similarity)
            # Parts again, as many as what is left needs, each of them some of the parts before; all in one where it fits a task.
            few = F.when(F.col("n") > verify_rows, F.ceil(2 * F.col("n") / verify_rows)).otherwise(1)
            few = whole.join(whole.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "comp").withColumn("of", F.least("parts", few).cast("int")).withColumn("own", F.floor(F.col("part") * F.col("of") / F.col("parts")).cast("int"))
            pairs = few.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).filter("of = 1 or own != other")
            block = F.concat("comp", F.encode(F.concat_ws("#", F.lit(""), F.least("own", "other"), F.greatest("own", "other")), "utf-8"))
            met = pairs.select(block.alias("block"), "part", "head", "grams").repartition("block").sortWithinPartitions("block").mapInArrow(_meet(similarity), "a binary, b binary")
            chain = _merged(chain, met)
    # Texts of many copies are groups too, whether a link was found or not.
    sized = marks.groupBy("th").agg(F.count(F.lit(1)).alias("copies")).join(chain, "th", "left").filter(F.col("head").isNotNull() | (F.col("copies") > _run.hot_size(total)))
    named = _run.join_groups(marks, _run.cut(sized), ["th"], "copies", total, "left").select("doc_id", "th", F.coalesce("head", "th").alias("class"))
    named = _run.cut(named)
    classes = _run.cut(named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    return _run.join_groups(named, classes, ["class"], "class_size", total).select("doc_id", "class_id", "class_size", "th")


def near_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay: of each class the one with the smallest id; all columns as they are.

    Of rows that repeat that id and text one stays. Where a class has no id at all, one row of each text stays.
    """
    th, other, own_id = _run.fresh(df, "th_", "gone_th_", "gone_id_")
    classes = _run.cut(near_classes(df, id_column, text_column, **options))
    gone = classes.filter("class_size > 1 and not doc_id <=> class_id").select(F.col("doc_id").alias(own_id), F.col("th").alias(other)).distinct()
    own = df.withColumn(th, F.unhex(F.md5(_run.utf8(text_column))))
    out = own.join(gone, (own[th] == gone[other]) & own[id_column].eqNullSafe(gone[own_id]), "left_anti")
    if not classes.filter("class_size > 1 and doc_id <=> class_id").groupBy("class_id", "doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates([id_column, th])
    return out.drop(th)
