"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to the 23 bits of
the perfect binary Golay code. Two fingerprints at most MAX_BITS = 4 bits apart have, by the pigeonhole
principle, two segments that together hold at most two of the differing bits. For such a pair of
segments a word within one bit of both exists, so decoding all words within one bit of each
fingerprint's segment pair to codeword indices gives both of them a common key (two 12-bit indices).
Fingerprints are joined on these keys and verified on all 64 bits; nothing is missed.

The pipeline's stage links texts whose sets of five-word shingles have Jaccard similarity SIMILARITY or more.
Such texts lie about ten bits apart, out of reach of the keys, so besides the Golay keys' links it takes
candidates from bands of minima over a sketch of each set (BANDS x ROWS). In each bucket a member meets the
nearest by the share of equal minima, and a maximal spanning forest keeps buckets connected, so pairs grow with
the members and not with their square. Each candidate is verified on the sketches: exactly for sets of up to SKETCH shingles, for longer texts by the SKETCH smallest of the union
(standard error 0.013). Where verification parts what candidates connected, all pairs between the parts that the minima or
the fingerprints hold to be alike are verified too, in blocks: a forest of unverified links loses none of them. Fewer than
five words are one shingle; texts without a word are alike.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows
keep one row each; a null doc_id gets its group's component; if a group has only null ids, so is its
component; ids of any size stay exact. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import whole_row
from tracemill.operators.graph import connected_components
from tracemill.operators.sieve import marked
from tracemill.storage import checkpointed, kept_at, removed, written

SHINGLE_WORDS, HASH_SEED, MAX_BITS = 4, 42, 4
#: Of the stage: words of a shingle, similarity of a link, shingles of a sketch, bands and minima of a band.
STAGE_WORDS, SIMILARITY, SKETCH, BANDS, ROWS = 5, 0.8, 1024, 20, 6
#: Of a bucket: members that one task compares (larger ones are split), nearest of each that are verified, and the
#: equal minima (of BANDS x ROWS) that they need: four standard errors below SIMILARITY.
MEMBERS, NEAREST = 4096, 3
ALIKE = int(BANDS * ROWS * SIMILARITY - 4 * (BANDS * ROWS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Fingerprints of one key that one task compares; larger keys are split into pairs of blocks.
BLOCK = 20_000

#: Generator polynomial of the (23, 12) Golay code, and the segments' (first bit, bits).
GENERATOR = 0xAE3
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _hashes(text: str | None, size: int) -> np.ndarray:
    """Unsigned hash of each shingle of the text's words (lower-cased A-Z, repeats included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-size].tolist()]
        shingles = map(joined.__getitem__, map(slice, starts, (ends[size - 1 :] - 1).tolist()))
    return np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash over the text's word shingles (lower-cased A-Z, repeats included)."""
    return _majority(_hashes(text, SHINGLE_WORDS))


def _prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield pd.Series(np.fromiter((fingerprint(t) for t in b), dtype="<u8", count=len(b)).view("<i8"))


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp, more): fp is the fingerprint as a signed long. Narrow; one pass over whole texts."""
    # so marked, it runs once a row, whatever is done with its result
    fp = F.pandas_udf(_prints, "long").asNondeterministic()("text")
    return docs.select(F.col("doc_id").cast("long"), *more, fp.alias("fp"))


def _remainders() -> np.ndarray:
    """Remainder modulo the generator of m * x^11, for each 12-bit m."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _corrections(remainders: np.ndarray) -> np.ndarray:
    """For each syndrome, the one error pattern of at most three bits that has it."""
    table = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            table[(error & 0x7FF) ^ remainders[error >> 11]] = error
    return table


_REMAINDERS = _remainders()
_CORRECTIONS = _corrections(_REMAINDERS)


def decode(word: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each 23-bit word."""
    return (word ^ _CORRECTIONS[(word & 0x7FF) ^ _REMAINDERS[word >> 11]]) >> 11


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints, each key once a row."""
    nearby = []
    for first, bits in SEGMENTS:
        word = (fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64) << (23 - bits)
        flips = np.array([0, *(1 << b for b in range(23 - bits, 23))], np.int64)
        nearby.append(decode(word[:, None] ^ flips[None, :]))
    rows, keys = [], []
    for k, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        both = np.hstack([nearby[a] << 12 | nearby[b][:, :1], nearby[a][:, :1] << 12 | nearby[b][:, 1:]])
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        rows.append(np.nonzero(first)[0])
        keys.append(both[first] | k << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy()
            rows, keys = keys_of(fps.view("<u8"))
            yield pd.DataFrame({"key": keys, "fp": fps[rows]})

    return distinct.select("fp").mapInPandas(run, "key long, fp long")


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected within one bucket, at most one fewer than its members."""
    left, out = fps[1:], []
    reached = [fps[0]]
    while len(left) or reached:
        if not reached:
            reached, left = [left[0]], left[1:]
        node = reached.pop()
        near = np.bitwise_count(left ^ node) <= MAX_BITS
        if near.any():
            out += [(node, other) for other in left[near]]
            reached += list(left[near])
            left = left[~near]
        if not len(left):
            break
    return out


def _links_in(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Verified links within runs of equal keys. keys: sorted, one row a fingerprint and key."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    links = [np.empty((0, 2), np.uint64)]
    pair = start[size == 2]
    near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= MAX_BITS]
    links.append(np.column_stack([fps[near], fps[near + 1]]))
    for s, n in zip(start[size > 2], size[size > 2], strict=True):
        if found := _forest(fps[s : s + n]):
            links.append(np.array(found, np.uint64))
    both = np.concatenate(links)
    return pd.DataFrame({"src": both[:, 0].view("<i8"), "dst": both[:, 1].view("<i8")})


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst): links between distinct fingerprints that join all that lie MAX_BITS or fewer apart.

    distinct: one row a fingerprint, column fp. Keys with over BLOCK fingerprints are cut into blocks and
    each pair of blocks becomes a bucket of its own, so no task holds an unbounded group.
    """
    keyed = _keyed(distinct)
    hot = checkpointed(
        keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp")
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
        dealt = (
            keyed.join(hot, "key", "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
        )
    bucket = F.col("key") * (1 << 36) + F.col("low") * (1 << 18) + F.col("high")
    placed = dealt.select(bucket.alias("bucket"), "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.empty(0, np.int64), np.empty(0, np.uint64))
        for b in batches:
            keys, fps = np.r_[held[0], b["bucket"].to_numpy()], np.r_[held[1], b["fp"].to_numpy().view("<u8")]
            whole = np.searchsorted(keys, keys[-1])  # the last bucket may go on in the next batch
            held = (keys[whole:], fps[whole:])
            if whole:
                yield _links_in(keys[:whole], fps[:whole])
        if len(held[0]):
            yield _links_in(*held)

    placed = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "fp")
    return placed.mapInPandas(run, "src long, dst long").distinct()


def _rooted(docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, more) of each row, and (fp, least, root) of each fingerprint; a component shares one root."""
    prints = written(fingerprints(docs, *more))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(written(links(distinct)))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, rooted.select("fp", "least", F.coalesce("component", "fp").alias("root"))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints, rooted = _rooted(docs)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits and the smallest doc_id of the component."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return components(docs).select("doc_id", digits.alias("fingerprint"), "component_id")


def _draws() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(HASH_SEED)
    factors = draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Of each text: its set's name and fingerprint, a key for each band of minima of its sketch, and a byte of each minimum."""
    factors, shifts = _draws()
    for b in batches:
        sets, fps, keys, minima = [], [], [], []
        for text in b:
            hashes = _hashes(text, STAGE_WORDS)
            distinct = np.unique(hashes.view("<i8"))
            sets.append(f"{xxhash.xxh3_128_hexdigest(distinct.tobytes())}{len(distinct):x}")
            fps.append(_majority(hashes))
            least = (distinct[:SKETCH].view("<u8")[:, None] * factors + shifts).min(axis=0, initial=np.uint64((1 << 64) - 1))
            keys.append([xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)])
            minima.append((least >> np.uint64(32)).astype(np.uint8).tobytes())
        yield pd.DataFrame({"set": sets, "fp": np.array(fps, "<u8").view("<i8"), "keys": keys, "minima": minima})


def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield pd.Series([np.unique(_hashes(text, STAGE_WORDS).view("<i8"))[:SKETCH] for text in b])


def _met(ids: np.ndarray, minima: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of one bucket to verify: each member's NEAREST, and a spanning forest of the most alike."""
    n, out = len(ids), []
    best, link, left = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    node, columns = 0, np.ascontiguousarray(minima.T)
    for _ in range(n):
        left[node] = False
        if best[node] >= ALIKE:
            out.append((ids[node], ids[link[node]]))
        equal = (columns == columns[:, node, None]).sum(axis=0, dtype=np.uint8).astype(np.int16)
        equal[node] = -1
        top = np.argpartition(equal, -NEAREST)[-NEAREST:] if n > NEAREST else np.arange(n)
        out += [(ids[node], ids[k]) for k in top if equal[k] >= ALIKE]
        nearer = left & (equal > best)
        best[nearer], link[nearer] = equal[nearer], node
        node = int(np.argmax(np.where(left, best, -2)))
    return out


def _met_in(buckets: np.ndarray, ids: np.ndarray, minima: np.ndarray) -> pd.DataFrame:
    """Pairs to verify of runs of equal buckets (sorted)."""
    start = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    size = np.diff(np.r_[start, len(buckets)])
    two = start[size == 2]
    two = two[(minima[two] == minima[two + 1]).sum(axis=1) >= ALIKE]
    met = [np.column_stack([ids[two], ids[two + 1]])]
    for s, n in zip(start[size > 2], size[size > 2], strict=True):
        if found := _met(ids[s : s + n], minima[s : s + n]):
            met.append(np.array(found, np.int64))
    both = np.concatenate(met)
    return pd.DataFrame({"id": both[:, 0], "other": both[:, 1]})


def _banded(sets: DataFrame) -> DataFrame:
    """(id, other): candidates of the bands. Of bands that hold the same members one is compared; keys with over
    MEMBERS are cut into blocks, and each pair of blocks is a bucket."""
    keyed = sets.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("two")).where("n > 1")
    chosen = shared.groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    dealt = keyed.join(chosen, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    placed = dealt.select(bucket.alias("bucket"), "id").join(sets.select("id", "minima"), "id")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BANDS * ROWS), np.uint8))
        for b in batches:
            minima = np.frombuffer(b"".join(b["minima"]), np.uint8).reshape(-1, BANDS * ROWS)
            held = (np.r_[held[0], b["bucket"].to_numpy()], np.r_[held[1], b["id"].to_numpy()], np.concatenate([held[2], minima]))
            whole = np.searchsorted(held[0], held[0][-1])  # the last bucket may go on in the next batch
            if whole:
                yield _met_in(*(h[:whole] for h in held))
            held = tuple(h[whole:] for h in held)
        if len(held[0]):
            yield _met_in(*held)

    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "id").mapInPandas(run, "id long, other long")


def _near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sketches are those of similar sets, as the verification of candidates takes it."""
    both = np.intersect1d(a, b, assume_unique=True)
    if len(a) < SKETCH and len(b) < SKETCH:
        return len(both) >= SIMILARITY * (len(a) + len(b) - len(both))
    sample = np.union1d(a, b)[:SKETCH]
    return int((both <= sample[-1]).sum()) >= SIMILARITY * len(sample)


def _between(ids: np.ndarray, parts: np.ndarray, fps: np.ndarray, minima: np.ndarray, sketches: list[np.ndarray]) -> list[tuple[int, int]]:
    """Verified links that connect what is connected between parts, of all pairs that minima or fingerprints hold to be alike."""
    parts, out = parts.copy(), []
    for k in range(len(ids) - 1):
        others = np.flatnonzero(parts[k + 1 :] != parts[k]) + k + 1
        equal = (minima[others] == minima[k]).sum(axis=1)
        alike = (equal >= ALIKE) | (np.bitwise_count(fps[others] ^ fps[k]) <= MAX_BITS)
        for other in others[alike][np.argsort(-equal[alike], kind="stable")]:
            if parts[other] != parts[k] and _near(sketches[k], sketches[other]):
                out.append((ids[k], ids[other]))
                parts[parts == parts[other]] = parts[k]
    return out


def _left_apart(sets: DataFrame, pairs: DataFrame, parts: DataFrame, sketched: DataFrame) -> DataFrame:
    """(src, dst): verified links between parts of one group. pairs: verified candidates (src, dst); what they connect is
    a group. parts: (id, part), what those of them that proved similar connect.

    Groups of one part or whose pairs were all verified are done. Of the others the largest part's members meet those of
    the rest only; members are cut into blocks of MEMBERS, and each pair of blocks is a bucket."""
    groups = written(connected_components(pairs).toDF("id", "group"))
    placed = written(groups.join(parts, "id", "left").select("id", "group", F.coalesce("part", "id").alias("part")))
    verified = pairs.select(F.col("src").alias("id")).join(groups, "id").groupBy("group").agg(F.count("*").alias("pairs"))
    sizes = placed.groupBy("group", "part").agg(F.count("*").alias("n")).groupBy("group")
    sizes = sizes.agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("most"))
    open_ = sizes.join(verified, "group").where("parts > 1 and pairs < n * (n - 1) div 2")
    blocks = lambda n: F.ceil(n / MEMBERS).cast("long")
    open_ = open_.select("group", F.col("most.part").alias("main"), blocks(F.col("most.n")).alias("mine"), blocks(F.col("n") - F.col("most.n")).alias("theirs"))
    members, main = placed.join(open_, "group"), F.col("part") == F.col("main")
    own = F.when(main, F.col("theirs") + F.pmod(F.xxhash64("id"), F.col("mine"))).otherwise(F.pmod(F.xxhash64("id"), F.col("theirs")))
    meets = F.when(main, F.col("theirs")).otherwise(F.col("theirs") + F.col("mine")) - 1
    dealt = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), meets)))
    bucket = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    told = sets.select("id", "fp", "minima").join(members.select("id"), "id").join(sketched, "id")
    placed = dealt.select(bucket.alias("bucket"), "id", "part").join(told, "id")
    parallel = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links_of(held: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, b in held.groupby("bucket", sort=False):
            minima = np.frombuffer(b"".join(b["minima"]), np.uint8).reshape(-1, BANDS * ROWS)
            found += _between(b["id"].to_numpy(), b["part"].to_numpy(), b["fp"].to_numpy().view("<u8"), minima, b["sketch"].tolist())
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["src", "dst"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            last = held["bucket"] == held["bucket"].iloc[-1]  # the last bucket may go on in the next batch
            yield links_of(held[~last])
            held = held[last]
        if held is not None:
            yield links_of(held)

    return placed.repartition(parallel, "bucket").sortWithinPartitions("bucket", "id").mapInPandas(run, "src long, dst long")


def _similar(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, root): what links of SIMILARITY connect, of sets (id, fp, keys, minima, one, two) with a link. texts: (one,
    two, text), one or more a set.

    Sketches are made, from the texts again, for sets with a candidate only: no sketch of other texts is written or moved,
    and of the other texts only those that the sieve takes for one of these are moved."""
    prints = written(sets.groupBy("fp").agg(F.min("id").alias("head")))
    one, two = prints.toDF("src", "id"), prints.toDF("dst", "other")
    coded = links(prints).join(one, "src").join(two, "dst").select("id", "other")
    alike = sets.select("id", "fp").join(prints, "fp").select("id", F.col("head").alias("other"))
    met = _banded(sets).union(coded).union(alike).where("id != other")
    pairs = written(met.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct())
    met = pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct()
    wanted = written(sets.select("id", "one", "two").join(met, "id"))
    sketch = F.pandas_udf(_sketches, "array<long>").asNondeterministic()("text")
    near_texts = marked(texts, wanted, "one").where("_marked").join(wanted, ["one", "two"])
    sketched = written(near_texts.select("id", sketch.alias("sketch")).groupBy("id").agg(F.first("sketch").alias("sketch")))
    a, b = sketched.toDF("src", "a"), sketched.toDF("dst", "b")
    both, either = F.array_intersect("a", "b"), F.array_union("a", "b")
    whole = (F.size("a") < SKETCH) & (F.size("b") < SKETCH)
    sample = F.slice(F.array_sort(either), 1, SKETCH)
    shared = F.when(whole, F.size(both)).otherwise(F.size(F.array_intersect(sample, both)))
    near = (shared >= SIMILARITY * F.when(whole, F.size(either)).otherwise(F.size(sample))) | (F.size(either) == 0)
    parts = written(connected_components(written(pairs.join(a, "src").join(b, "dst").where(near).select("src", "dst"))).toDF("id", "part"))
    more = written(_left_apart(sets, pairs, parts, sketched))
    if more.isEmpty():
        return parts.withColumnRenamed("part", "root")
    part = lambda end: parts.toDF(end, f"{end}_part")
    ends = more.join(part("src"), "src", "left").join(part("dst"), "dst", "left").select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst"))
    joined = written(connected_components(written(ends)).toDF("part", "root"))
    # a part of one set is none of parts', so it stands for itself
    named = parts.join(joined, "part", "left").select("id", F.coalesce("root", "part").alias("root"))
    alone = joined.join(parts, joined["part"] == parts["id"], "left_anti").select(F.col("part").alias("id"), "root")
    return named.unionByName(alone)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs' rows, one of each group that links of SIMILARITY connect: that of the smallest doc_id (nulls last, then
    by its set of shingles, then by a hash of the whole row, so reruns agree).

    Null and empty texts are one group; repeated rows are one; all columns of docs are returned, of any name."""
    row = whole_row(docs)
    digest = F.struct(F.xxhash64(row).alias("one"), F.xxhash64(F.lit(1), row).alias("two"))
    made = F.pandas_udf(_sets, "set string, fp long, keys array<long>, minima binary").asNondeterministic()("text")
    seen, seen_at = kept_at(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), made.alias("made")).select("doc_id", "digest", "made.*"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set", "digest")
    told = (F.first(c).alias(c) for c in ("fp", "keys", "minima"))
    sets, sets_at = kept_at(seen.groupBy("set").agg(F.min(order).alias("first"), *told).withColumn("id", F.monotonically_increasing_id()))
    found = _similar(sets.select("*", "first.digest.*"), docs.select(digest.alias("_digest"), "text").select("_digest.*", "text"))
    rooted = sets.select("id", "first").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.digest.*", F.lit(True).alias("stays"))
    # most rows are alone and stay where they are; those that go or are repeated, and what the sieve takes for them, meet the join
    rows = seen.select("digest.*").groupBy("one", "two").agg(F.count("*").alias("n")).join(chosen, ["one", "two"], "left")
    touched = written(rows.where("stays is null or n > 1").select("one", "two", F.coalesce("stays", F.lit(False)).alias("stays")))
    removed(docs.sparkSession, seen_at, sets_at)
    # two columns, not one struct: the join's exchange then serves the grouping too, and whole rows are moved once
    again = marked(docs.select(row.alias("_row"), digest.alias("_digest")).select("_row", "_digest.*"), touched, "one")
    met = again.where("_marked").join(touched, ["one", "two"], "left").where("stays is null or stays").dropDuplicates(["one", "two"])
    return again.where("not _marked").select("_row.*").union(met.select("_row.*"))
