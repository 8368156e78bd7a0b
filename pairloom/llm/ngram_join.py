"""Near duplicates by an exact Jaccard join over word n-grams, with token-combination prefixes.

A document's set is its distinct windows of ``n`` words (tokens, below), as 64-bit hashes. Two sets of Jaccard
similarity t or more share all but tau = |x| - ceil(t |x|) tokens of either. Tokens have one global order, by rising
number of sets that hold them. Token classes: *unshared* (one set; they only count), *rare* (at most the root of the
number of documents, so that one token brings no more pairs than there are documents) and *frequent*.

* Rare tokens are indexed singly: those among the first tau + 1 tokens of a set. If two similar sets share a rare
  token at all, they share such a one.
* If all unshared and rare tokens of a set (a of them) could be missing on the other side, its prefix is extended into
  the frequent ones and 2-token combinations are indexed: each frequent token with the next one. For similar sets
  2 |x - y| + |y - x| <= 2 (1 - t) |x|. A token of x alone breaks at most two neighbourhoods and one of y alone
  at most one, so among the first floor(2 (1 - t) |x|) - 2 a + 2 frequent tokens at least one neighbourhood is whole in
  both. Their number grows with the set, not with its square, and a passage or phrase that many documents share
  brings no candidates unless it makes up nearly all of both.
* Sets that meet are compared by a bitmap of 64 x ``WORDS`` bits, each the parity of the tokens hashed to it: as many bits
  differ as tokens differ, or fewer, so too many differing bits rule a pair out. What is left is verified on the sets.

Sets that hold too few shared tokens for any partner are dropped before that, so what follows is the size of the near
duplicates. The links between copies and in large groups are not listed: equal sets are one class; sets of equal
min-hash are first compared with the one among them that has the fewest unshared tokens. The index then joins
components found so far, not sets, and only sets of two different components that meet are compared. Every link between
different sets is either verified or inside one component, so components are exact.

Scale: texts are dealt to chunks by a hash and read twice. A chunk sends each of its distinct tokens once, as a
short fingerprint with a count, sorted and delta coded (about two bytes a token), to be counted in slices of the
fingerprint space; the answer is one compressed byte per token. A token in every document has one entry a
chunk. Fingerprints only decide order and classes: if two tokens share one, both count as more frequent, which costs
candidates and loses none. Similarities use the 64-bit hashes.

Defined cases: null, empty and blank texts have empty sets and link with nothing; a text with fewer than ``n`` words
has one token, the whole sequence; repeated rows are linked to each other; a null doc_id never names a component (a
group without any id has none); texts of any length are one set in one row; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt, log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import steps
from pairloom.llm.spans import hashes, words
from pairloom.operators.clusters import connected_components
from pairloom.session import write_through

#: Words of a window, and the similarity in percent.
SHINGLE, PERCENT = 4, 85
#: Characters of a chunk and of a step inside it, and tokens of a slice.
CHUNK_CHARS, STEP_CHARS, SLICE_TOKENS = 4_000_000, 500_000, 1_000_000
#: Min-hashes by which large groups are found first.
MIN_HASHES = 3
#: 64-bit words of a set's bitmap.
WORDS = 8
#: Parts that the sets of one min-hash are dealt to.
SALTS = 64

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct token hashes of each text."""
    return [s for low, high in steps(texts, STEP_CHARS) for s in _sets_of(texts[low:high], n)]


def _sets_of(texts: list[str], n: int) -> list[np.ndarray]:
    raw, first, last, counts = words(texts)
    if not len(first):
        return [np.zeros(0, np.uint64)] * len(texts)
    word = _mix(hashes(raw, first, last))
    factors = [_mix(_ODD[k % 4 : k % 4 + 1] + np.uint64(k))[0] | np.uint64(1) for k in range(n)]
    windows = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k, factor in enumerate(factors):
        windows += word[k : k + len(windows)] * factor
    windows = _mix(windows)
    sets, start = [], 0
    for count in counts.tolist():
        if count >= n:
            sets.append(np.unique(windows[start : start + count - n + 1]))
        else:
            short = sum((word[start + k : start + k + 1] * factors[k] for k in range(count)), np.zeros(1, np.uint64))
            sets.append(_mix(short + np.uint64(count)) if count else np.zeros(0, np.uint64))
        start += count
    return sets


# ------------------------------------------------------------------------- counting in slices


def _pack(values: np.ndarray) -> bytes:
    """Rising integers, delta coded in byte planes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def _fingerprints(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct fingerprints of a chunk and the number of distinct sets that hold each."""
    distinct = {s.tobytes(): s for s in sets if len(s)}
    if not distinct:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(list(distinct.values())) >> np.uint64(64 - bits), return_counts=True)


def _slice_of(prints: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """Rising slices for rising fingerprints, equally wide."""
    return ((prints >> np.uint64(max(0, bits - 32))) * np.uint64(slices) >> np.uint64(min(32, bits))).astype(np.int64)


def frequency_class(count: np.ndarray) -> np.ndarray:
    """0 for one set, and then by eighths of powers of two."""
    return np.where(count > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(count, 1)))), 0).astype(np.uint8)


def _count_slice(group: pa.Table) -> pa.Table:
    chunks, payloads, counts = (group[c].to_pylist() for c in ("chunk", "prints", "counts"))
    prints = [_unpack(p) for p in payloads]
    every = np.concatenate(prints)
    kinds, place = np.unique(every, return_inverse=True)
    each = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(c), "<u4") for c in counts])
    classes = frequency_class(np.bincount(place, each, minlength=len(kinds)))[place]
    cuts = np.cumsum([0, *map(len, prints)])
    pack = zstandard.ZstdCompressor(level=1).compress
    answers = [pack(classes[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "slice": group["slice"], "classes": pa.array(answers, pa.binary())})


# ---------------------------------------------------------------------------------- signatures


def signatures(size: int, tokens: np.ndarray, classes: np.ndarray, rare: int, percent: int = PERCENT) -> np.ndarray:
    """What a set is indexed by: ``tokens`` are its shared tokens in the global order, ``rare`` the last rare class."""
    tau = size - -(-percent * size // 100)
    unshared = size - len(tokens)
    n_rare = int((classes <= rare).sum())
    found = [_mix(tokens[: max(0, min(n_rare, tau + 1 - unshared))] ^ _ODD[1])]
    absent = unshared + n_rare
    spare = 2 * (100 - percent) * size // 100 - 2 * absent
    if absent <= tau and spare >= 0:
        frequent = tokens[n_rare : n_rare + spare + 2]
        found.append(_mix(_mix(frequent[:-1]) * _ODD[2] + frequent[1:]))
    return np.concatenate(found)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """The parities of the tokens at each of 64 x WORDS places."""
    places = _mix(tokens ^ _ODD[3]) % np.uint64(64 * WORDS)
    odd = np.bincount(places.astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def least_size(percent: int = PERCENT) -> int:
    """The fewest tokens with which a set can link to a different one."""
    return -(-percent // (100 - percent))


def _describe(sets: list[np.ndarray], answers: list[tuple[int, bytes]], bits: int, rare: int, percent: int) -> list[tuple]:
    """(n, digest, tokens, signatures, min-hashes, bitmap) of each set of a chunk; from the tokens on only where a
    partner is possible."""
    prints, _ = _fingerprints(sets, bits)
    unpack = zstandard.ZstdDecompressor().decompress
    classes = np.frombuffer(b"".join(unpack(raw) for _, raw in sorted(answers)), np.uint8)
    if len(classes) != len(prints):
        raise ValueError("a chunk has changed between two readings")
    rows = []
    for tokens in sets:
        n = len(tokens)
        digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).hexdigest() if n else None
        row = (n, digest, None, None, None, None)
        if n >= least_size(percent):
            own = classes[np.searchsorted(prints, tokens >> np.uint64(64 - bits))]
            shared = own > 0
            if 100 * int(shared.sum()) >= percent * n:
                held, own = tokens[shared], own[shared]
                order = np.lexsort((held, own))
                keys = signatures(n, held[order], own[order], rare, percent).astype(np.int64)
                mins = [int(_mix(held * _ODD[k % 4] + np.uint64(k)).min().astype(np.int64)) for k in range(MIN_HASHES)]
                row = (n, digest, held.tobytes(), keys.tolist(), mins, bitmap(tokens).tolist())
        rows.append(row)
    return rows


_SETS = "doc_id long, text_id string, n int, digest string, tokens binary, keys array<long>, mins array<long>, bits array<long>"
_LONGS = pa.list_(pa.int64())
_SET_KINDS = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary(), _LONGS, _LONGS, _LONGS]


def described(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: its set's size and digest and, where a partner is possible, what the join needs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_id", _text_id())
    count, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks, total = 1 + chars // CHUNK_CHARS, max(1024, chars // 4)
    slices = 1 + total // SLICE_TOKENS
    # Wide enough that about one fingerprint in a thousand is shared by chance.
    bits = min(64, int(log2(total)) + 10)
    rare = int(frequency_class(np.array([max(2, isqrt(count))]))[0])
    # Copies of a text have different ids, so they too spread over chunks.
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def fingerprints(group: pa.Table) -> pa.Table:
        prints, counts = _fingerprints(shingle_sets(group["text"].to_pylist(), n), bits)
        cuts = np.searchsorted(_slice_of(prints, slices, bits), np.arange(slices + 1))
        chunk = group["chunk"][0].as_py()
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [
            (k, chunk, _pack(prints[a:b]), pack(counts[a:b].astype("<u4").tobytes()))
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
            if b > a
        ]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["slice", "chunk", "prints", "counts"])

    sent = dealt.groupBy("chunk").applyInArrow(fingerprints, "slice long, chunk long, prints binary, counts binary")
    answers = sent.groupBy("slice").applyInArrow(_count_slice, "chunk long, slice long, classes binary")

    def describe(group: pa.Table, answer: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], t) for t in _SET_KINDS], [c.split()[0] for c in _SETS.split(", ")])
        sets = shingle_sets(group["text"].to_pylist(), n)
        got = list(zip(answer["slice"].to_pylist(), answer["classes"].to_pylist()))
        ids = zip(group["doc_id"].to_pylist(), group["text_id"].to_pylist())
        rows = [(*d, *r) for d, r in zip(ids, _describe(sets, got, bits, rare, percent))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _SET_KINDS)], [c.split()[0] for c in _SETS.split(", ")])

    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(describe, _SETS)


# --------------------------------------------------------------------------------------- links


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of digests whose sets are similar enough."""
    side = lambda name: sets.select(
        F.col("digest").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"tokens_{name}")
    )
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "tokens_u", "tokens_v")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_u, n_v, one, two in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep.append(100 * common >= percent * (n_u + n_v - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(similar, "u string, v string")


def _side(sets: DataFrame, name: str) -> DataFrame:
    """What two sets are compared by before their tokens are, with ``name`` on every column."""
    words_ = [F.col("bits")[k].alias(f"{name}{k}") for k in range(WORDS)]
    return sets.select(F.col("digest").alias(name), F.col("n").alias(f"n_{name}"), F.col("label").alias(f"l_{name}"), *words_)


def _possible(percent: int) -> Column:
    """Whether sizes and bitmaps of u and v allow a link: |x - y| + |y - x| is at most (1 - t) / (1 + t) of |x| + |y|."""
    n_u, n_v = F.col("n_u"), F.col("n_v")
    differing = sum((F.bit_count(F.col(f"u{k}").bitwiseXOR(F.col(f"v{k}"))) for k in range(1, WORDS)), F.bit_count(F.col("u0").bitwiseXOR(F.col("v0"))))
    close = (100 + percent) * differing <= (100 - percent) * (n_u + n_v)
    return (100 * n_u >= percent * n_v) & (100 * n_v >= percent * n_u) & close


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) of digests with the components of all links. ``sets`` has one row per distinct set."""
    held = (F.octet_length("tokens") / 8).cast("int").alias("held")
    sets = sets.select("digest", "n", held, "keys", "mins", "bits", "tokens")
    grouped = sets.select("digest", (F.col("n") - F.col("held")).alias("unshared"), F.posexplode("mins").alias("which", "mark"))
    # A large group is dealt to parts, first to find its leader and then to meet it.
    grouped = grouped.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    least = F.min(F.struct("unshared", "digest")).alias("leader")
    parts = grouped.groupBy("which", "mark", "salt").agg(least, F.count(F.lit(1)).alias("members"))
    leaders = parts.groupBy("which", "mark").agg(F.min("leader").alias("leader"), F.sum("members").alias("members"))
    leaders = leaders.filter("members > 1").select("which", "mark", F.col("leader.digest").alias("v"))
    met = parts.select("which", "mark", "salt").join(leaders, ["which", "mark"])
    first = grouped.join(met, ["which", "mark", "salt"]).filter("digest <> v").select(F.col("digest").alias("u"), "v").distinct()
    alone = sets.withColumn("label", F.col("digest"))
    first = first.join(_side(alone, "u"), "u").join(_side(alone, "v"), "v").filter(_possible(percent)).select("u", "v")
    edges = write_through(verified(first, sets, percent))

    found = connected_components(edges).select(F.col("id").alias("digest"), F.col("cluster_id").alias("label"))
    labelled = write_through(
        sets.drop("tokens", "mins").join(found, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    )
    # Components meet on a key; only keys with two or more of them can bring new links.
    meeting = labelled.select("label", "n", "held", F.explode("keys").alias("key")).groupBy("key", "label").agg(
        F.max("held").alias("held"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    meeting = write_through(meeting)
    mixed = meeting.groupBy("key").agg(F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("key")
    meeting = meeting.join(mixed, "key", "left_semi")
    one = meeting.select("key", *[F.col(c).alias(f"{c}_a") for c in ("label", "held", "low", "high")])
    two = meeting.select("key", *[F.col(c).alias(f"{c}_b") for c in ("label", "held", "low", "high")])
    # What two sets share is at most what the one with fewer shared tokens holds, and at least t / (1 + t) of both.
    enough = (100 + percent) * F.least("held_a", "held_b") >= percent * (F.col("low_a") + F.col("low_b"))
    fits = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    pairs = one.join(two, "key").filter((F.col("label_a") < F.col("label_b")) & enough & fits).select("label_a", "label_b").distinct()
    # Only sets that hold a mixed key themselves can be the ones that link.
    open_ = labelled.select("digest", F.explode("keys").alias("key")).join(mixed, "key", "left_semi").select("digest").distinct()
    members = write_through(labelled.join(open_, "digest", "left_semi"))
    # Of two components the smaller one is listed, and each of its sets meets the other one in one join.
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    for side in ("a", "b"):
        pairs = pairs.join(sizes.toDF(f"label_{side}", f"members_{side}"), f"label_{side}")
    swap = F.col("members_a") > F.col("members_b")
    pairs = pairs.select(
        F.when(swap, F.col("label_b")).otherwise(F.col("label_a")).alias("small"),
        F.when(swap, F.col("label_a")).otherwise(F.col("label_b")).alias("large"),
    )
    second = (
        pairs.join(_side(members, "u"), F.col("small") == F.col("l_u"))
        .join(_side(members, "v"), F.col("large") == F.col("l_v"))
        .filter(_possible(percent))
        .select("u", "v")
    )
    return edges.unionAll(verified(second, sets, percent))


def _text_id() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _clustered(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, text_id, n, cluster, component_id) of every row; ``cluster`` is null for a text without words."""
    rows = write_through(described(docs, n, percent))
    sets = write_through(rows.filter("tokens IS NOT NULL").select("digest", "n", "tokens", "keys", "mins", "bits").dropDuplicates(["digest"]))
    named = connected_components(links(sets, percent)).select(F.col("id").alias("digest"), "cluster_id")
    least = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    least = least.join(named, "digest", "left").withColumn("cluster", F.coalesce("cluster_id", "digest"))
    of_cluster = least.groupBy("cluster").agg(F.min("least").alias("component_id"))
    classes = least.join(of_cluster, "cluster").select("digest", "cluster", "component_id")
    alone = F.when(F.col("digest").isNull(), F.col("doc_id"))
    return rows.select("doc_id", "text_id", "n", "digest").join(classes, "digest", "left").select(
        "doc_id", "text_id", "n", "cluster", F.coalesce("component_id", alone).alias("component_id")
    )


def components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest doc_id that links reach."""
    return _clustered(docs, n, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of every component, the one that names it, with all columns of ``docs``.

    Where texts of one component share that doc_id, the one of least digest stays, and one row of it; another text under
    the same doc_id is judged by its own component. Texts without words link with nothing, so all of them stay, and
    so do rows without a doc_id, which cannot be told apart.
    """
    found = _clustered(docs, n, percent).filter("cluster IS NOT NULL AND doc_id = component_id")
    kept = found.groupBy("cluster").agg(F.min(F.struct("doc_id", "text_id")).alias("kept")).select("kept.*").distinct()
    # Names that no column of ``docs`` has.
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long"), _text_id().alias("text_id"), F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("has_words"))
    known = marked.filter("doc_id IS NOT NULL AND has_words").join(kept, ["doc_id", "text_id"], "left_semi")
    known = known.groupBy("doc_id", "text_id").agg(F.first("row").alias("row"))
    others = marked.filter("doc_id IS NULL OR NOT has_words")
    return known.select("row.*").unionAll(others.select("row.*"))
