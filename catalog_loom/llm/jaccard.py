"""N-gram Jaccard join by filtering under several global orders, and the components of its links.

A document's set holds hashes of its 5-word shingles (64 bits; equal hashes count as equal shingles). Documents with equal
sets are one class, so copies are never paired; sets are told apart by 128 bits, and where two share the 64 that name a class
they take the other 64. Two sets link when 100 * intersection >= 80 * union.

Any global order of shingles gives a filter that loses no link: the first n - ceil(0.8 n) + 1 shingles of two linked sets
share one. Three orders are used. The first puts common shingles last (by a sketch of document frequencies, of a fixed
size, then by a hash); it makes candidates: prefix shingles are shuffled, and classes that share one may link. The second
and third (the hash upwards and downwards) are tested on each candidate, and only those that pass all are verified on the
whole sets; the second is tested before any text is moved. Shingles that the sketch calls common are salted when their
postings are gathered, and joins with what is found for a shingle, a class or a component send the hot ones by broadcast, so
that none of them is one task.

Shingles of few classes give all their pairs. For a shingle of many classes (near copies, mostly), all are compared with
one of them and the components of the links found so far are taken. What is then still apart is compared: the classes that
such shingles hold together are dealt to blocks, by number and by shingles. Components that fill a block have blocks of
their own, which are never sent to each other; other blocks are sent to those with which they share a shingle, and a task
counts the intersections of two blocks' sets at once, without making rows of pairs. No pair that could still join two
components is left out. Texts are sent, as they take less room than 64 bits a shingle.

The sketch and the bitmap that says which classes' texts are wanted grow with the table up to 2^24 cells and 2^30 bits. With
more rows than these tell apart, more pairs are tested and more texts are sent; none is lost.

Defined cases: null texts and texts without words have no shingles, 0 as size, and link with nothing; fewer than five words
are one shingle; rows are the nodes, so repeated rows and rows that share a doc_id are each their own; component_id is the
smallest doc_id of the component, null ids ignored (null if there is none); an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog_loom.llm.components import components
from catalog_loom.llm.shared import free_name, hashable, join_by_size, mapped, named, observed, stage, table
from catalog_loom.llm.textops import ASCII_LOWER, NOT_SPACE, Rolling, buffers, mix, slices, spans

WORDS = 5
SKETCH_BITS = (22, 24)
SKETCH_BLOCKS = 64
MEMBER_BITS = (23, 30)
SEEN_KEPT = 100_000
HELD = 1 << 19
FEW = 64
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
BROADCAST_ROWS = 100_000
LEVEL_SHIFT = 59
MOST_CLASHES = 100_000
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within each row, and row offsets."""
    low = ASCII_LOWER[raw]
    starts, ends, counts = spans(NOT_SPACE[low], at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    words = mix(Rolling(low).of(starts, ends))
    stops = np.cumsum(counts)
    number = np.where(counts > 0, np.maximum(1, counts - (WORDS - 1)), 0)
    heads = np.r_[0, np.cumsum(number)]
    first = np.repeat(stops - counts - heads[:-1], number) + np.arange(heads[-1])
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    padded = np.r_[words, np.zeros(WORDS - 1, np.uint64)]
    h = padded[first] * _FACTORS[0]
    for j in range(1, WORDS):
        word = padded[first + j]
        gone = short[counts[short] <= j]
        word[heads[gone]] = 0
        h += word * _FACTORS[j]
    h = mix(h)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[heads[:-1][number > 0]] = True
    return h[fresh], np.r_[0, np.cumsum(fresh)][heads]


def classes(h: np.ndarray, at: np.ndarray, shared_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An id for each row's set and 64 further bits of its hash, which are the id where that is one of shared_ids."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        a, b, n = np.add.reduceat(mix(h, 1), at[some]), np.add.reduceat(mix(h, 2), at[some]), np.diff(at)[some].astype(np.uint64)
        out[0, some], out[1, some] = mix(a + mix(b + n)), mix(b + mix(a + n, 6), 7)
    ids, more = out.view(np.int64)
    return np.where(np.isin(ids, shared_ids), more, ids) if len(shared_ids) else ids, more


def bits_for(cells: int, bounds: tuple[int, int]) -> int:
    """The least number of bits that tell so many cells apart, within bounds."""
    return min(max(max(cells - 1, 0).bit_length(), bounds[0]), bounds[1])


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    return n - (4 * n + 4) // 5 + 1


def described(docs: DataFrame, shared_ids: np.ndarray, width: int) -> DataFrame:
    """doc_id, row_key, n, cls, more of each document; and, as rows with a block, counts of shingles by cell (of 2 ** width), part by part."""
    names = ["doc_id", "row_key", "n", "cls", "more", "block", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << width, np.uint32)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                at, n = np.unique((np.concatenate(held) >> np.uint64(64 - width)).astype(np.int32), return_counts=True)
                cells[at] += n.astype(np.uint32)
                held.clear()

        for batch in batches:
            for lo, hi, raw, at in slices(batch["text"]):
                h, to = shingles(raw, at)
                held.append(mix(h, 3))
                if sum(map(len, held)) > HELD:
                    flush()
                n, none = hi - lo, np.diff(to) == 0
                cls, more = classes(h, to, shared_ids)
                own = [batch["doc_id"].slice(lo, n).cast(pa.int64()), batch["row_key"].slice(lo, n), pa.array(np.diff(to)), pa.array(cls, mask=none), pa.array(more, mask=none)]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(n, types[5]), pa.nulls(n, types[6])], names)
        flush()
        parts = np.split(cells, SKETCH_BLOCKS)
        used = [i for i, p in enumerate(parts) if p.any()]
        nothing = [pa.nulls(len(used), t) for t in types[:5]]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(used, types[5]), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in used], types[6])], names)

    return mapped(docs.select("doc_id", "row_key", "text"), run, "doc_id long, row_key long, n long, cls long, more long, block int, counts binary")


def levels(parts: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each cell are: 0 for most, then a step for each doubling. Of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
                new = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
                sums[block] = sums[block] + new if block in sums else new.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["block", "counts"])

    cells = np.zeros((SKETCH_BLOCKS, (1 << width) // SKETCH_BLOCKS), np.uint64)
    for row in mapped(parts.select("block", "counts").repartition(SKETCH_BLOCKS, "block"), run, "block int, counts binary").toLocalIterator():
        cells[row["block"]] += np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    limit = cells.mean() + 5 * np.sqrt(cells.mean()) + 4
    return np.minimum(15, np.where(cells > limit, 1 + np.floor(np.log2(np.maximum(cells, 1) / limit)), 0)).astype(np.uint8).ravel()


def level_of(tok: str) -> Column:
    """How common the sketch calls a shingle: the highest bits of its place in the first order."""
    return F.shiftrightunsigned(tok, LEVEL_SHIFT)


def postings(docs: DataFrame, sent: Broadcast, shared_ids: np.ndarray, width: int) -> DataFrame:
    """tok, cls, n: the prefix of each class under the first order. Copies in one task are mostly left out. sent: the
    levels, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, at in slices(batch["text"]):
                h, to = shingles(raw, at)
                size, cls = np.diff(to), classes(h, to, shared_ids)[0]
                spread = mix(h, 3)
                key = (common[(spread >> np.uint64(64 - width)).astype(np.int64)].astype(np.uint64) << np.uint64(LEVEL_SHIFT)) | (mix(h, 4) >> np.uint64(64 - LEVEL_SHIFT))
                rows = []
                for i, c in enumerate(cls.tolist()):
                    if size[i] and c not in seen:
                        seen.add(c)
                        rows.append(i)
                        key[to[i] : to[i + 1]].sort()
                if len(seen) > SEEN_KEPT:
                    seen.clear()
                rows = np.array(rows, np.int64)
                take = prefix_length(size[rows])
                ends = np.cumsum(take)
                chosen = np.repeat(to[rows] - (ends - take), take) + np.arange(ends[-1] if len(ends) else 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[chosen].view(np.int64)), pa.array(np.repeat(cls[rows], take)), pa.array(np.repeat(size[rows], take).astype(np.int32))], ["tok", "cls", "n"])

    return mapped(docs.select("text"), run, "tok long, cls long, n int")


def cell_of(cls: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each class in a bitmap of 2 ** width bits."""
    cell = (mix(cls.view(np.uint64), 5) >> np.uint64(64 - width)).astype(np.int64)
    return cell >> 3, (1 << (cell & 7)).astype(np.uint8)


def members(ids: DataFrame, width: int) -> np.ndarray:
    """A bitmap of 2 ** width bits that holds the cells of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (width - 3), np.uint8)
        for batch in batches:
            np.bitwise_or.at(bits, *cell_of(batch["cls"].to_numpy(), width))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(1 << (width - 3), np.uint8)
    for row in mapped(ids.select("cls").coalesce(16), run, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def texts_of(docs: DataFrame, sent: Broadcast, shared_ids: np.ndarray, width: int) -> DataFrame:
    """cls, text, low (start of the second order) of each class whose cell is in the bitmap (sent, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, raw, at in slices(batch["text"]):
                h, to = shingles(raw, at)
                cls = classes(h, to, shared_ids)[0]
                rows = []
                byte, bit = cell_of(cls, width)
                for i in np.flatnonzero((bits[byte] & bit > 0) & (np.diff(to) > 0)).tolist():
                    if int(cls[i]) not in seen:
                        seen.add(int(cls[i]))
                        rows.append(i)
                if len(seen) > SEEN_KEPT:
                    seen.clear()
                low = pa.array([(h[to[i] : to[i] + sketch_length(int(to[i + 1] - to[i]))] >> np.uint64(32)).astype("<u4").tobytes() for i in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), batch["text"].slice(lo, hi - lo).take(pa.array(rows, pa.int64())).cast(pa.string()), low], ["cls", "text", "low"])

    return mapped(docs.select("text"), run, "cls long, text string, low binary").dropDuplicates(["cls"])


def sketch_length(n: int) -> int:
    return -(-n // 4)


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
    """The filter of the second order, on the starts of two sets of n and m shingles: linked ones share at least
    (4 / 9) (n + m), so of the first n - that + k and m - that + k they share k. Halves of hashes can only share more."""
    least = -(-4 * (n + m) // 9)
    k = min(len(a) - (n - least), len(b) - (m - least))
    if k < 1:
        return True
    return len(np.intersect1d(a[: n - least + k], b[: m - least + k])) >= k - 2  # two are left for equal halves


def passing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, n, m) that pass the second order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch["n"].to_pylist(), batch["m"].to_pylist()
            good = [i for i, (x, y) in enumerate(zip(batch["left"], batch["right"], strict=True)) if may_link(np.frombuffer(x.as_py(), "<u4"), n[i], np.frombuffer(y.as_py(), "<u4"), m[i])]
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(rows), batch["b"].take(rows)], ["a", "b"])

    low = texts.select("cls", "low")
    both = pairs.join(low.withColumnsRenamed({"cls": "a", "low": "left"}), "a").join(low.withColumnsRenamed({"cls": "b", "low": "right"}), "b")
    return mapped(both.select("a", "b", "n", "m", "left", "right"), run, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets link: the filters of the second and third order, then the sets."""
    n, m = len(a), len(b)
    p, q = prefix_length(n), prefix_length(m)
    if 5 * min(n, m) < 4 * max(n, m) or not len(np.intersect1d(a[:p], b[:q], True)) or not len(np.intersect1d(a[n - p :], b[m - q :], True)):
        return False
    both = len(np.intersect1d(a, b, True))
    return 100 * both >= 80 * (n + m - both)


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in slices(batch["left"]):
                left, left_at = shingles(raw, at)
                for lo2, hi2, raw2, at2 in slices(batch["right"].slice(lo, hi - lo)):
                    right, right_at = shingles(raw2, at2)
                    good = [i for i in range(lo2, hi2) if linked(left[left_at[i] : left_at[i + 1]], right[right_at[i - lo2] : right_at[i - lo2 + 1]])]
                    rows = pa.array([lo + i for i in good], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch["a"].take(rows), batch["b"].take(rows)], ["a", "b"])

    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("right")), "b")
    return mapped(both.select("a", "b", "left", "right"), run, "a long, b long")


def blocks_for(many: str, weight: str) -> Column:
    return F.ceil(F.greatest(F.lit(1), F.col(many) / BLOCK, F.col(weight) / BLOCK_SHINGLES)).cast("int")


def dealt(apart: DataFrame, total: int) -> DataFrame:
    """cls, root, toks, block, pairs of apart(tok, cls, n, root), total rows: the block that has the class, and the pairs x <= y of
    blocks that it is needed for. Classes that shingles hold together, directly or through others, share blocks of BLOCK classes
    and BLOCK_SHINGLES shingles (a longer text is alone in excess of that). A root with as many has blocks of its own."""
    hubs = apart.groupBy("tok").agg(F.min("cls").alias("hub"), F.count("*").alias("many"))
    held = components(join_by_size(apart, hubs, "tok", "many", total).select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct())
    classes_of = apart.groupBy("cls").agg(F.collect_set("tok").alias("toks"), F.max("root").alias("root"), F.max("n").cast("long").alias("n"))  # a prefix at most
    found = stage(classes_of.join(held.select(F.col("node").alias("cls"), F.col("root").alias("held_by")), "cls"), "held")

    sums = [F.count("*").alias("many"), F.sum("n").alias("weight")]
    alone = found.groupBy("root").agg(*sums).select("root", "many", blocks_for("many", "weight").alias("blocks"))
    found = stage(join_by_size(found, alone, "root", "many", total), "sized")
    large, small = found.where("blocks > 1"), found.where("blocks = 1").drop("blocks")
    together = small.groupBy("held_by").agg(*sums).select("held_by", "many", blocks_for("many", "weight").alias("blocks"))
    small = join_by_size(small, together, "held_by", "many", total)
    place = lambda kind, owner: F.concat_ws("/", F.lit(kind), owner, F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block")
    placed = large.select("cls", "root", "toks", place("root", "root"), F.col("root").alias("sole"))
    placed = stage(placed.unionByName(small.select("cls", "root", "toks", place("shared", "held_by"), F.lit(None).cast("long").alias("sole"))), "placed")

    meets = placed.select(F.explode("toks").alias("tok"), "block", "sole").distinct()
    x, y = meets.select("tok", F.col("block").alias("x"), F.col("sole").alias("s")), meets.select("tok", F.col("block").alias("y"), F.col("sole").alias("t"))
    pairs = x.join(y, "tok").where((F.col("x") <= F.col("y")) & F.coalesce(F.col("s") != F.col("t"), F.lit(True))).select("x", "y").distinct()
    needs = pairs.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("block"), F.struct("x", "y").alias("pair")).groupBy("block").agg(F.collect_list("pair").alias("pairs"))
    return placed.drop("sole").join(needs, "block")


def blockwise(apart: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between classes that share a shingle of apart(tok, cls, n, root), total rows, and have different roots. A
    task has the members of two blocks."""
    sent = dealt(apart, total).join(texts.select("cls", "text"), "cls").select("cls", "root", "block", "toks", "text", F.explode("pairs").alias("pair"))
    sent = sent.select("pair.x", "pair.y", "cls", "root", "block", "toks", "text")

    def run(table: pa.Table) -> pa.Table:
        cls, root = table["cls"].to_numpy(), table["root"].to_numpy()
        second = pc.equal(table["block"], table["y"]).to_numpy()
        raw, at = buffers(table["text"])
        h, to = shingles(raw, at)
        size = np.diff(to)
        count = len(cls)
        may = np.zeros((count, count), bool)
        tok = table["toks"].combine_chunks()
        owner = np.repeat(np.arange(count), tok.value_lengths().to_numpy())
        tok = tok.flatten().to_numpy()
        order = np.argsort(tok, kind="stable")
        for same in np.split(owner[order], np.flatnonzero(np.diff(tok[order])) + 1):
            if len(same) > 1:
                may[np.ix_(same, same)] = True
        cross = table["x"][0].as_py() != table["y"][0].as_py()
        may &= (root[:, None] != root[None, :]) & (5 * np.minimum(size[:, None], size[None, :]) >= 4 * np.maximum(size[:, None], size[None, :]))
        may &= (~second[:, None] & second[None, :]) if cross else np.triu(np.ones((count, count), bool), 1)
        known, dense = np.unique(h, return_inverse=True)
        nth = np.arange(len(h)) - np.repeat(to[:-1], size)
        length = np.repeat(size, size)
        kinds = (np.ones(len(h), bool), nth < prefix_length(length), nth >= length - prefix_length(length))
        flag = np.zeros(len(known), np.int32)

        def shared(i: int, kind: np.ndarray) -> np.ndarray:
            mine = dense[to[i] : to[i + 1]][kind[to[i] : to[i + 1]]]
            flag[mine] = 1
            got = np.add.reduceat(np.where(kind, flag[dense], 0), to[:-1])
            flag[mine] = 0
            return got

        found = []
        above = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        for i in np.flatnonzero(may.any(axis=1)):
            good = may[i] & (shared(i, kinds[1]) > 0)
            good = good & (shared(i, kinds[2]) > 0) if good.any() else good
            if good.any():
                both = shared(i, kinds[0])
                for j in np.flatnonzero(good & (100 * both >= 80 * (size[i] + size - both))):
                    x, y = top(int(root[i])), top(int(root[j]))
                    if x != y:  # else the link joins nothing
                        above[x] = y
                        found.append((cls[i], cls[j]))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("x", "y").applyInArrow(run, "a long, b long")


def fits(n: str, m: str):
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def gathered(posts: DataFrame) -> DataFrame:
    """tok, cls, n, many, hub, hub_n of the postings whose shingle several classes hold: how many, and the least of them.
    Shingles that the sketch calls common are gathered by salt first."""
    level = level_of("tok")
    salts = (64 * F.pow(F.lit(2), level)).cast("long")
    posts = posts.withColumn("salt", F.when(level == 0, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("cls"), salts)))
    by = Window.partitionBy("tok", "salt")
    posts = posts.withColumn("first", F.min(F.struct("cls", "n")).over(by)).withColumn("last", F.max("cls").over(by)).withColumn("many", F.count("*").over(by))
    kept = posts.where((level > 0) | (F.col("first.cls") != F.col("last"))).drop("salt")
    found, of = observed(kept, "postings", common=F.count_if(level > 0))
    hub = [F.col("first.cls").alias("hub"), F.col("first.n").alias("hub_n")]
    rare, common = found.where(level == 0).select("tok", "cls", "n", "many", *hub), found.where(level > 0)
    total = of["common"]
    if not total:
        return rare
    whole = common.groupBy("tok").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("rows")).where(F.col("first.cls") != F.col("last"))
    whole = whole.select("tok", "rows", F.col("rows").alias("many"), *hub)
    joined_rows = join_by_size(common.select("tok", "cls", "n"), whole, "tok", "rows", total)
    return rare.unionByName(stage(joined_rows, "common"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """For documents with a row_key: doc_id, row_key, n, cls of each; cls, root, component_id, copies of each class; and the
    number of documents with words."""
    context = docs.sparkSession.sparkContext
    shared_ids = np.zeros(0, np.int64)
    width = bits_for(4 * docs.count(), SKETCH_BITS)
    while True:
        found = stage(described(docs, shared_ids, width), "described")
        rows = found.where("block is null").select("doc_id", "row_key", "n", "cls", "more")
        known = rows.where("cls is not null").groupBy("cls")
        sets = known.agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("more").alias("low"), F.max("more").alias("high"))
        sets, of = observed(sets, "sets", clashes=F.count_if(F.col("low") != F.col("high")), documents=F.coalesce(F.sum("copies"), F.lit(0)))
        if not of["clashes"]:
            break
        if of["clashes"] > MOST_CLASHES:
            raise ValueError("far more sets share 64 bits of their hash than chance allows")
        clashing = [r["cls"] for r in sets.where("low <> high").select("cls").collect()]
        shared_ids = np.unique(np.concatenate([shared_ids, np.array(clashing, np.int64)]))
    rows, sets, n_docs = rows.drop("more"), sets.drop("low", "high"), of["documents"]

    sent = context.broadcast(zlib.compress(levels(found.where("block is not null"), width).tobytes(), 1))  # a byte a cell at most
    shared = gathered(postings(docs, sent, shared_ids, width))
    ids, of = observed(shared.select("cls").distinct(), "shared", n=F.count("*"))
    size = bits_for(8 * of["n"], MEMBER_BITS)
    wanted = context.broadcast(zlib.compress(members(ids, size).tobytes(), 1))  # a bit a cell at most
    texts = stage(texts_of(docs, wanted, shared_ids, size), "texts")
    sent.destroy()
    wanted.destroy()

    few = shared.where(F.col("many") <= FEW).select("tok", "cls", "n")
    other = few.select("tok", F.col("cls").alias("b"), F.col("n").alias("m"))
    pairs = few.withColumnRenamed("cls", "a").join(other, "tok").where((F.col("a") < F.col("b")) & fits("n", "m")).select("a", "b", "n", "m")
    crowd = shared.where(F.col("many") > FEW)
    stars = crowd.where((F.col("cls") != F.col("hub")) & fits("n", "hub_n")).select(F.col("hub").alias("a"), F.col("cls").alias("b"), F.col("hub_n").alias("n"), F.col("n").alias("m"))
    tried = stage(passing(pairs.unionByName(stars).distinct(), texts), "pairs")
    good = stage(links(tried, texts), "links")
    roots = components(good)
    crowd = crowd.select("tok", "cls", "n").distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    crowd, of = observed(crowd, "crowd", n=F.count("*"))
    total = of["n"]
    ends = crowd.groupBy("tok").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high").select("tok", "many")
    apart, of = observed(join_by_size(crowd, ends, "tok", "many", total), "apart", n=F.count("*")) if total else (crowd, {"n": 0})
    if of["n"]:
        reached = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))  # these have the components of the links found so far
        roots = components(reached.unionByName(stage(blockwise(apart, texts, of["n"]), "links")))

    rooted = stage(sets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    named_sets = join_by_size(rooted, ids, "root", "many", n_docs).select("cls", "root", "component_id", "copies")
    return rows, stage(named_sets, "named"), n_docs


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    rows, named_sets, n_docs = grouped(docs.select("doc_id", "text", F.lit(0).cast("long").alias("row_key")))
    found = join_by_size(rows.where("cls is not null"), named_sets.drop("root"), "cls", "copies", n_docs)
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(rows.where("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns: that of smallest doc_id (null last), and of smallest hash among rows
    that share it. Documents without words all stay."""
    columns = docs.columns
    mark, key, ident = (free_name(columns, x) for x in ("row_mark", "key_mark", "id_mark"))
    keyed = docs.withColumn(mark, F.xxhash64(*hashable(docs)))
    rows, named_sets, _ = grouped(keyed.select("doc_id", "text", F.col(mark).alias("row_key")))
    rows = rows.where("cls is not null")
    least = rows.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least"))
    best = least.join(named_sets.select("cls", "root"), "cls").groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.row_key")
    many = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("many"))
    same = (F.col("m.row_key") == F.col("b.row_key")) & F.col("m.doc_id").eqNullSafe(F.col("b.doc_id"))
    told = many.alias("m").join(best.alias("b"), same, "left").select("m.doc_id", "m.row_key", "m.many", F.col("b.row_key").isNotNull().alias("stays"))
    told = stage(told.where("not stays or many > 1"), "told")

    def among(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(ident), F.col("row_key").alias(key))
        keys = F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
        return frame.join(keys, (F.col(mark) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(ident)), how)

    kept = among(keyed, told.where("not stays"), "left_anti")
    again = told.where("stays")
    own = [named(c) for c in columns]
    if again.isEmpty():
        return kept.select(own)
    twice = among(kept, again, "left_semi").dropDuplicates(["doc_id", mark])
    return among(kept, again, "left_anti").select(own).unionByName(twice.select(own))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
