"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are computed in one pass over the texts (A-Z lower-cased). Equal fingerprints become one class. For a
radius r the classes are put in r + 1 Gray orders, each with another of r + 1 blocks of bits rotated to the front: two
codes within r bits have one block in common, so in that order the beginnings of their codes are equal. Each order is
sorted by Gray rank and cut into groups of equal beginnings, as many bits of the block as leave about ``GROUP`` codes in a
group. In a group the hierarchical index finds the links: upper nodes hold the bit patterns that Gray neighbours share,
and whole groups are pruned by their accumulated differences. A group of over ``RANGE`` codes is cut into ranges: each
range's shared pattern is an upper node too, and only ranges whose patterns are within the radius meet. Tasks return spanning forests of links, never all pairs. Components are then found
with distributed star rounds.

Null texts count as empty; texts without words have fingerprint 0, linked like any other. A text is handled whole,
whatever its length. Repeated rows stay repeated. Rows whose id is null keep their fingerprint and get their group's
component (null where all ids of the group are). Ties don't occur: a link depends on two fingerprints only. An empty
table gives no rows. Other columns of the table, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from schemaloom.llm.common import discard, map_rows, materialise, mix, spread_join, table
from schemaloom.llm.components import components
from schemaloom.llm.gray_index import Forest, GrayIndex, gray_rank

SHINGLE, RADIUS, TILE = 3, 3, 512
#: Codes in a range of a Gray order, and in a group of it.
RANGE, GROUP = 1 << 16, 1 << 11
#: For similarity of sets: minima by band, bands, and the radii at which the fingerprints in a bucket are linked.
ROWS, BANDS, RADII = 6, 20, (3, 6, 9, 12, 16)
_MASKS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_MASKS) | np.uint64(1)
_TOP = np.uint64(1 << 63)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of all shingles of ``width`` words, as a signed 64-bit value."""
    words = (text or b"").lower().split()  # of bytes: lowers A-Z only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    h = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 65536):
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp bigint)."""
    return map_rows(docs.select("doc_id", "text"), lambda: lambda i, t: (i, fingerprint(t, width)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def ranks(codes: np.ndarray) -> np.ndarray:
    """Gray ranks as signed values of the same order."""
    return (gray_rank(codes) ^ _TOP).view(np.int64)


def codes_of(rank: np.ndarray) -> np.ndarray:
    """The codes of such ranks."""
    r = rank.view(np.uint64) ^ _TOP
    return r ^ (r >> np.uint64(1))


def orders(codes: np.ndarray, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, rank), a column for each of radius + 1 orders: the order and the first ``bits`` bits of its block, and the
    Gray rank of the code with that block rotated to the front."""
    u, keys, places = np.uint64, [], []
    for k in range(radius + 1):
        shift = u(64 * k // (radius + 1))
        code = (codes << shift) | (codes >> (u(64) - shift)) if shift else codes
        keys.append((u(k) << u(32)) | (code >> u(64 - bits) if bits else u(0)) & u(0xFFFFFFFF) | np.zeros_like(codes))
        places.append(ranks(code))
    return np.stack(keys, 1).view(np.int64), np.stack(places, 1)


def near_links(classes: DataFrame, radius: int = RADIUS, group: int = GROUP, size: int = RANGE) -> DataFrame:
    """classes(rep bigint, fp bigint), distinct in fp -> (a, b): spanning forests of the links of at most ``radius`` bits."""
    n = classes.count()
    bits = min(64 // (radius + 1), max(0, (n // group).bit_length() - 1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, rank = orders(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), radius, bits)
            at = pa.array(np.repeat(np.arange(b.num_rows), radius + 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(rank.ravel()), b.column(0).take(at)], names=["key", "rank", "rep"])

    routed = classes.select("rep", "fp").mapInArrow(route, "key long, rank long, rep long")
    return bucket_links(routed, (radius,), n * (radius + 1), size=size)


def stars(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that tie every member of a group to its first."""
    _, first, of = np.unique(group, return_index=True, return_inverse=True)
    rest = np.delete(np.arange(len(group)), first)
    return rest, first[of[rest]]


def chains(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that tie every member of a group to the one before it, so that none is in more than two pairs."""
    at = np.argsort(group, kind="stable")
    same = group[at[1:]] == group[at[:-1]]
    return at[1:][same], at[:-1][same]


def _forests(rank: np.ndarray, rep: np.ndarray, radii: tuple[int, ...], tied: Callable):
    """Links of one bucket, whose rows are in Gray order: equal codes and, for each radius, groups of the index."""
    if len(rank) < 2:
        return
    codes, first, of = np.unique(rank, return_index=True, return_inverse=True)
    yield from _named(rep, tied(of))
    if len(codes) > 1:
        rep, index = rep[first], GrayIndex(codes_of(codes))
        for radius in radii:
            yield from _named(rep, tied(index.components(radius)))


def _named(rep, pairs):
    if len(pairs[0]):
        yield rep[pairs[0]], rep[pairs[1]]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Runs of rows with equal first ``keys`` columns, all columns being numbers, over batches: the first, the last and
    those of more than one row; others have no pair and are passed over (but where a batch ends)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cut = np.r_[0, np.flatnonzero(new), len(cols[0])]
        some = np.diff(cut) > 1
        some[[0, -1]] = True
        for k in np.flatnonzero(some):
            part = [c[cut[k] : cut[k + 1]] for c in cols]
            if held and any(held[0][k][0] != part[k][0] for k in range(keys)):
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def bucket_links(routed: DataFrame, radii: tuple[int, ...], rows: int, tied: Callable = stars, size: int = RANGE) -> DataFrame:
    """routed(key, rank, rep), all bigint, about ``rows`` rows -> (a, b): for each bucket (key) and radius its groups, each
    tied together by ``tied``.

    Buckets are dealt in order of (key, rank). What a partition holds of a bucket is joined there. Only its first and last
    bucket may go on in other partitions; their rows are kept, and the pieces of a bucket are put together to ranges of
    about ``size`` rows, each joined in one task. Two ranges of a bucket are joined where the patterns that their codes
    share differ in no more bits than the last radius and the bucket isn't connected yet, so a bucket of fewer than
    ``size`` rows is never dealt twice, and a larger one only as far as its upper nodes can't be pruned."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, at = TaskContext.get().partitionId(), None, 0

        def edge(g):
            key, rank, rep = g
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rank), pa.array(key), pa.array(np.full(len(key), part, np.int64))], names=["a", "b", "key", "part"])

        for g in _grouped(batches, 1):
            if at == 0:
                yield edge(g)
            before, at = g, at + 1
            for a, b in _forests(g[1], g[2], radii, tied):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], names=["a", "b", "key", "part"])
        if at > 1:
            yield edge(before)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, rank, rep in _grouped(batches, 3):
            at = np.argsort(rank, kind="stable")
            for a, b in _forests(rank[at], rep[at], radii, tied):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ranged = routed.repartitionByRange(max(1, -(-rows // size)), "key", "rank").sortWithinPartitions("key", "rank")
    found = materialise(ranged.mapInArrow(inside, "a long, b long, key long, part long"))
    edges = found.where("key is not null").select("key", "part", F.col("b").alias("rank"), F.col("a").alias("rep"))
    links = found.where("key is null").select("a", "b")
    plain = F.col("rank").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    code = plain.bitwiseXOR(F.shiftrightunsigned(plain, 1))
    pieces = edges.withColumn("c", code).groupBy("key", "part").agg(F.bit_and("c").alias("every"), F.bit_or("c").alias("some"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")
    pieces = materialise(pieces.withColumn("t", F.floor(before / size).cast("long")))
    nodes = pieces.groupBy("key", "t").agg(F.bit_and("every").alias("every"), F.bit_or("some").alias("some"), F.count("*").alias("pieces"))
    other = nodes.select("key", F.col("t").alias("t2"), F.col("every").alias("every2"), F.col("some").alias("some2"))
    apart = F.bit_count(F.expr("(every ^ every2) & ~(every ^ some) & ~(every2 ^ some2)"))
    pairs = nodes.withColumnRenamed("t", "t1").join(other, "key").where((F.col("t1") < F.col("t2")) & (apart <= max(radii))).select("key", "t1", "t2")
    if tied is stars and not pairs.isEmpty():  # links are certain: a bucket that they connect has no more to give
        linked = components(links)
        loose = edges.join(linked, F.col("rep") == F.col("node"), "left").groupBy("key").agg(F.min(F.coalesce("component", "rep")).alias("low"), F.max(F.coalesce("component", "rep")).alias("high")).where("low <> high")
        pairs = materialise(pairs.join(loose.select("key"), "key", "left_semi"))
    own = nodes.where("pieces > 1").select("key", F.col("t").alias("t1"), F.col("t").alias("t2"))
    meet = own.withColumn("t", F.col("t1")).union(pairs.withColumn("t", F.explode(F.array("t1", "t2"))))
    meet = meet.join(pieces.select("key", "t", "part"), ["key", "t"]).select("key", "part", "t1", "t2")
    dealt = edges.join(meet, ["key", "part"]).select("key", "t1", "t2", "rank", "rep")
    across = dealt.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").mapInArrow(between, "a long, b long")
    return links.union(across)


def groups(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most ``radius`` bits."""
    prints = materialise(fingerprints(docs, width))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(near_links(classes.where("rep is not null"), radius))
    named = materialise(classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")))
    return spread_join(prints, named, "fp", prints.count()).select("doc_id", "fp", "component_id")


def sketch(text: bytes | None, width: int) -> tuple[int, int, bytes, bytes]:
    """(digest, fp, bands, hashes) of the set of a text's shingles of ``width`` words.

    The digest is one for each set; fp has the majority bits of the set; bands are ``BANDS`` values, one of which two
    sets share with a chance of 1 - (1 - j^ROWS)^BANDS at a similarity of j (0.998 at 0.8); hashes are 64 bits a shingle,
    in order.
    """
    words = (text or b"").lower().split()
    shingles = set(map(b" ".join, zip(*(words[k:] for k in range(width))))) if len(words) >= width else {b" ".join(words)} - {b""}
    h = np.array([xxhash.xxh64_intdigest(s, seed=42) for s in shingles], np.uint64)
    h.sort()
    low, ones = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64)
    for a in range(0, len(h), 2048):
        part = h[a : a + 2048]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        low = np.minimum(low, ((part[:, None] ^ _MASKS) * _FACTORS).min(0))
    fp = int(np.packbits(2 * ones > len(h)).view(">i8")[0])
    bands = [xxhash.xxh64_intdigest(b.tobytes(), seed=k) for k, b in enumerate(low.reshape(BANDS, ROWS))]
    digest = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))
    return digest, fp, np.array(bands, np.uint64).tobytes(), h.tobytes()


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sorted sets of 64-bit hashes; two empty ones are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def rest_links(routed: DataFrame, sets: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """routed(key, rep, part), sets(digest, hashes) -> (a, b): links between the parts of a bucket.

    ``part`` is what verified links already connect. A bucket of more than one part goes on until each of its pairs
    within the last of ``RADII`` is verified on the whole sets or connected by verified links. Buckets of more than
    ``tile`` members are dealt out as pairs of tiles, so no task holds an unbounded bucket and no pair is dropped."""
    tiles = F.ceil(F.col("n") / tile).cast("int")
    todo = routed.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key", tiles.alias("t"))
    dealt = routed.join(todo, "key").withColumn("mine", F.pmod(F.xxhash64("rep"), "t").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    dealt = materialise(dealt.select("key", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "mine", "rep", "part"))
    reps = materialise(dealt.select(F.col("rep").alias("digest")).distinct())
    used = sets.join(reps, "digest", "left_semi").dropDuplicates(["digest"])

    def join(key, rows):
        size = pc.binary_length(rows["hashes"]).to_numpy() // 8
        rows = rows.take(pa.array(np.argsort(size, kind="stable")))
        rep, side = rows["rep"].to_numpy(), rows["mine"].to_numpy()
        size = pc.binary_length(rows["hashes"]).to_numpy() // 8
        start = np.cumsum(size) - size
        word = np.unique(np.frombuffer(b"".join(rows["hashes"].to_pylist()), np.uint64), return_inverse=True)[1].astype(np.int32)
        part = np.unique(rows["part"].to_numpy(), return_inverse=True)[1]
        forest, held = Forest(int(part.max()) + 1), np.zeros(len(word), bool)
        # Sizes grow, so the sets that can be alike are those up to a size; one without words has no such set.
        most = np.searchsorted(size, size / similarity + 1e-6, side="right")
        a, b = [], []
        for i in np.flatnonzero(size):
            root = forest.roots()[part]
            j = np.arange(i + 1, most[i])
            j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (key[1].as_py() == key[2].as_py()))]
            if not len(j):
                continue
            mine = word[start[i] : start[i] + size[i]]
            held[mine] = True
            first = np.cumsum(size[j]) - size[j]
            both = np.add.reduceat(held[word[np.repeat(start[j] - first, size[j]) + np.arange(size[j].sum())]], first, dtype=np.int64)
            held[mine] = False
            j = j[both / (size[i] + size[j] - both) >= similarity]
            j = j[np.unique(root[j], return_index=True)[1]]
            forest.link(np.full(len(j), part[i]), part[j])
            a.append(np.full(len(j), rep[i]))
            b.append(rep[j])
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    found = materialise(dealt.join(used, F.col("rep") == F.col("digest")).drop("digest").groupBy("key", "t1", "t2").applyInArrow(join, "a long, b long"))
    discard(dealt, reps)
    return found


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, tile: int = TILE, extra: tuple[str, ...] = (), size: int = RANGE) -> DataFrame:
    """(doc_id, *extra, component_id, group): documents linked where their sets of ``width``-word shingles (A-Z lower-cased)
    are ``similarity`` alike.

    Equal sets become one class. At that similarity fingerprints differ in about 10 bits, too many for blocks of bits in
    common, so classes are routed by ``BANDS`` minima of their sets instead; the Gray-order index of each bucket gives
    groups at growing ``RADII``, each tied together as a chain of Gray neighbours (no text has a hub's number of links),
    and only links whose similarity holds on the whole sets are used. Where they leave a bucket in several parts,
    ``rest_links`` verifies the pairs between them.
    component_id is the smallest doc_id of the group (null only where all its ids are); group tells groups apart. Texts
    without words are equal. Repeated rows stay repeated.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *extra))
    prints = materialise(map_rows(docs.select("text", "doc_id", *extra), lambda: lambda t, *ids: (*ids, *sketch(t, width)), f"{kinds}, digest long, fp long, bands binary, hashes binary"))
    classes = materialise(prints.groupBy("digest").agg(F.min(F.struct("fp", "bands")).alias("x")).select("digest", "x.*"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(digest, fp or part, bands) -> a row for each band."""
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            second = b.column(1)
            if b.schema.names[1] == "fp":
                second = pa.array(ranks(second.to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), second.take(at), b.column(0).take(at)], names=["key", b.schema.names[1].replace("fp", "rank"), "rep"])

    found = bucket_links(classes.select("digest", "fp", "bands").mapInArrow(route, "key long, rank long, rep long"), RADII, classes.count() * BANDS, chains, size)
    links = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # Written, so that Spark knows its size: where it is small it is broadcast, and the sets stay where they are.
    ends = materialise(links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "digest"))
    sets = materialise(prints.select("digest", "hashes").join(ends, "digest", "left_semi").dropDuplicates(["digest"]))
    pairs = links.join(sets.select(F.col("digest").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("hashes").alias("y")), "b")
    checked = map_rows(pairs.select("a", "b", "x", "y"), lambda: lambda a, b, x, y: (a, b, jaccard(x, y) >= similarity), "a long, b long, near boolean")
    linked = materialise(components(checked.where("near").select("a", "b")))
    parts = classes.join(linked, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("component", "digest").alias("part"), "bands")
    rest = rest_links(parts.mapInArrow(route, "key long, part long, rep long"), prints.select("digest", "hashes"), similarity, tile)
    linked = components(rest.union(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    per = prints.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    per = materialise(per.join(linked, F.col("digest") == F.col("node"), "left").select("digest", "n", "low", F.coalesce("component", "digest").alias("group")))
    named = spread_join(per.select("digest", F.col("n").alias("rows"), "group"), per.groupBy("group").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "group", per.count())
    named = materialise(named.withColumnRenamed("rows", "n"))
    out = materialise(spread_join(prints.select("doc_id", *extra, "digest"), named, "digest", prints.count()).select("doc_id", *extra, "component_id", "group"))
    discard(prints, classes, links, ends, sets, per, named)
    return out


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of ``similar_groups``: the one with the smallest doc_id (null ids last), of several
    with that id the one with the smallest hash of the row, and of rows equal in all columns one."""
    row, key = "_near_dedup_row", ["doc_id", "_near_dedup_row"]
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns, *(F.col(f"`{c}`").isNull() for c in docs.columns)))
    member = similar_groups(keyed.select(*key, "text"), width, similarity, extra=(row,))
    per = materialise(member.groupBy(*key).agg(F.min("group").alias("group"), F.count("*").alias("times")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    stays = materialise(per.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    marked = spread_join(per, stays, "group", per.count()).withColumn("gone", F.col("first") != place).where("gone or times > 1")
    marked = materialise(marked.select(F.col("doc_id").alias("marked_id"), F.col(row).alias("marked_row"), "gone"))
    same = F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col(row) == F.col("marked_row"))
    once = keyed.join(marked.where("not gone"), same, "left_semi").dropDuplicates(key)
    return keyed.join(marked, same, "left_anti").unionByName(once).select(*docs.columns)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_dedup": op7_simhash_dedup}
