"""SimHash near-duplicates: fingerprints of word shingles, found by multi-index hashing and joined into groups."""

from __future__ import annotations

import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, components, discard, texts, written

#: What ends a word, and the seed of a shingle's hash.
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SEED = 42


def shingles(text: str, size: int) -> list[bytes]:
    """The text's shingles of ``size`` words, A-Z in lower case; its whole sequence if it has fewer, none without words."""
    words = _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return []
    data = " ".join(words).encode("utf-8", "surrogatepass")
    if len(words) <= size:
        return [data]
    ends = [*np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist(), len(data)]
    starts = [0, *(e + 1 for e in ends)]
    return [data[a:b] for a, b in zip(starts, ends[size - 1 :])]


def majority(parts: Collection[bytes], seed: int = SEED) -> int:
    """64 bits, each set where it is set in over half the hashes of ``parts``; 0 if there are none."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((hashed(p, seed) for p in parts), np.uint64, len(parts)))


def majority_bits(values: np.ndarray) -> int:
    """64 bits, each set where it is set in over half of ``values``; 0 if there are none."""
    if not len(values):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        set_bits += np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.packbits(set_bits * 2 > len(values), bitorder="little")).view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of a text's shingles, repeats included."""
    return majority(shingles(text, shingle))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(documents: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long; null and empty texts have 0."""
    run = lambda rows: {"doc_id": rows["doc_id"], "fp": [_signed(fingerprint(t, shingle)) for t in rows["text"]]}
    return batches(texts(documents, id_col, text_col), run, "doc_id long, fp long")


def near_pairs(codes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints in ``codes(fp)`` that differ in ``distance`` bits or fewer.

    Fingerprints are distinct, so a group of copies is one of them, and none has more partners than its ball of
    ``distance`` bits has codes.
    """
    return meetings(codes.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), 1, distance, named=False).distinct()


def segment(fp: Column, lo: int, hi: int) -> Column:
    """Bits ``lo`` to ``hi`` of a fingerprint."""
    return F.shiftrightunsigned(fp, lo).bitwiseAND((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)


def segment_ball(fp: Column, lo: int, hi: int, both: bool = True) -> Column:
    """The segment's keys within one bit; unless ``both``, only its own and those with one bit more."""
    masks = F.array(*map(F.lit, [0, *((1 << b) - (1 << 64 if b == 63 else 0) for b in range(hi - lo))])).cast("array<long>")
    own = segment(fp, lo, hi)
    return F.transform(masks if both else F.filter(masks, lambda m: own.bitwiseAND(m) == 0), lambda m: own.bitwiseXOR(m))


def meetings(nodes: DataFrame, tables: int, distance: int, segments: int | None = None, named: bool = True) -> DataFrame:
    """``u, v`` (u <= v, repeats possible) of ``nodes(node, fps)``, of which one of the fingerprints is near the other's.

    Multi-index hashing: the 64 bits are cut into so many segments that of two fingerprints within ``distance`` one segment
    differs in at most one bit (two segments of 32 bits for 3 bits, three for 5). Each fingerprint probes the Hamming balls
    of radius one around its segments in the table of segments, and full distances are checked on what is found. With fewer
    ``segments`` than that, pairs of larger distances are found only where their bits fall so. Nodes that are not ``named``
    are their own one fingerprint, which the index then needn't hold besides.
    """
    count = segments or distance // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    entry = lambda t, n, key, fp: F.struct(F.lit(t * count + n).alias("segment"), key.alias("key"), *([fp.alias("fp")] if named else []))
    parts = [(t, n, F.get("fps", F.lit(t)), lo, hi) for t in range(tables) for n, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    # Only the side without the differing bit probes: it meets the other's entry in the table.
    ball = lambda t, n, fp, lo, hi: F.transform(segment_ball(fp, lo, hi, False), lambda k: entry(t, n, k, fp))
    table = nodes.select("node", F.inline(F.array(*(entry(t, n, segment(fp, lo, hi), fp) for t, n, fp, lo, hi in parts))))
    probes = nodes.select(F.col("node").alias("other"), F.inline_outer(F.concat(*(ball(*part) for part in parts)))).withColumnRenamed("fp", "code")
    near = F.bit_count(F.col("fp" if named else "node").bitwiseXOR(F.col("code" if named else "other"))) <= distance
    joined = table.hint("merge").join(probes.hint("merge"), ["segment", "key"]).where((F.col("node") != F.col("other")) & near)
    return joined.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))


def groups(found: DataFrame, distance: int = 3) -> DataFrame:
    """``fp, component`` for ``found(doc_id, fp)``: the smallest doc_id that links reach from each fingerprint.

    Equal fingerprints are one node, however many documents hold it. Only nodes with a link beyond themselves enter the
    iteration; the component of a fingerprint is then the least id of its nodes.
    """
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    pairs = near_pairs(nodes.select("fp"), distance)
    reached = components(pairs, "near")
    parts = nodes.join(reached.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = parts.groupBy("part").agg(F.min("least").alias("component"))
    return parts.select("fp", "part").hint("merge").join(least.hint("rebalance").hint("merge"), "part").select("fp", "component")


def simhash_groups(documents: DataFrame, distance: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every document.

    Fingerprints are computed in one pass and written; everything after works on distinct fingerprints, which a group of
    copies shares. Null and empty texts, and those without words, have fingerprint 0 and are linked like any other.
    Ids may repeat (each row keeps its own fingerprint) or be null (never a component's id, unless all its ids are
    null); an empty table gives an empty result; other columns are not read.
    """
    found = written(fingerprints(documents, shingle, id_col, text_col), "simhash")
    named = groups(found, distance)
    return found.hint("merge").join(named.hint("merge"), "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles, as in ``shingles``: each word is hashed once, and a shingle mixes its words' hashes."""
    import xxhash

    words = _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    of = {w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in set(words)}
    values = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    width = min(size, len(values))
    mixed = np.full(len(values) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + values[i : i + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def bucket_leaders(nodes: DataFrame, distance: int) -> DataFrame:
    """``u, v``: of ``nodes(node, fp, rank)``, pairs of a node and the least-ranked node of a bucket it meets in the index.

    The table and probes are those of ``meetings``; each bucket gives its leader only, so a bucket makes no more pairs than
    it has probes. ``rank`` is any orderable value.
    """
    count = distance // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    parts = [(n, lo, hi) for n, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    entry = lambda n, key: F.struct(F.lit(n).alias("segment"), key.alias("key"))
    table = nodes.select("node", "fp", "rank", F.inline(F.array(*(entry(n, segment(F.col("fp"), lo, hi)) for n, lo, hi in parts))))
    leader = table.groupBy("segment", "key").agg(F.min_by(F.struct(F.col("node").alias("other"), F.col("fp").alias("code")), F.struct("rank", "node")).alias("leader"))
    ball = lambda n, lo, hi: F.transform(segment_ball(F.col("fp"), lo, hi), lambda k: entry(n, k))
    probes = nodes.select("node", "fp", F.inline_outer(F.concat(*(ball(*part) for part in parts))))
    met = probes.hint("merge").join(leader.hint("rebalance").hint("merge"), ["segment", "key"]).select("node", "fp", "leader.*")
    met = met.where((F.col("node") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("code"))) <= distance))
    return met.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))


def similar_groups(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, component_id, kept``: groups of documents whose sets of ``shingle``-word shingles have so high a Jaccard similarity.

    Exact, up to collisions of 64-bit hashes, whatever finds the candidates. Texts with equal sets are one node, so copies don't
    multiply. A set that is similar to another lacks at most ``(1 - similarity)`` of its shingles there; so nodes of which more shingles
    (counted on those that a fixed three eighths of all hashes pick) stand in no other row have no partner, and only one text of each
    node that is left is read again. Of these, nodes meet

    - the leaders of the multi-index buckets that their SimHash fingerprint falls into, within ``distance`` bits;
    - the leader of each shingle of their prefix: shingles are ordered by frequency, rarest first, and similar sets share one among
      the first ``size - ceil(similarity * size) + 1``. Its place and the sizes bound what two sets can have in common;
    - then, as fingerprints can't promise every pair, all nodes of a prefix shingle that no link joins to them yet.

    A leader is the node with the smallest share of shingles of its own: in a group of copies with edits here and there, the one that
    most of them resemble. What is left to the last step then doesn't grow with the square of a group unless its texts are alike without
    being similar. The exact similarity decides on every pair.

    A row is known by its id and its text's hash: ids may be null or repeat. ``kept`` is true for one such row of each group (and exact repeats
    of it), the one with the smallest id, ids before null. ``component_id`` is that id. Null and empty texts are alike. An empty table gives an empty
    result; columns of other names are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    least_shared = F.ceil(F.col("size") * similarity - 1e-9)

    def marked(rows: dict) -> dict:
        import xxhash

        sets = [shingle_set(t, shingle) for t in rows["text"]]
        nodes = [_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets]
        # 40 bits do here: a collision only makes a shingle seem shared.
        return {"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "node": nodes, "size": [len(s) for s in sets], "sample": [(s[s & np.uint64(7) < 3] >> np.uint64(24)).astype(np.int64) for s in sets]}

    def hashed(rows: dict) -> dict:
        import xxhash

        sets = [shingle_set(t, shingle) for t in rows["text"]]
        return {"node": [_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], "fp": [_signed(majority_bits(s)) for s in sets], "hashes": [s.tobytes() for s in sets]}

    def spread(rows: dict) -> dict:
        sets = [np.frombuffer(h, np.int64) for h in rows["hashes"]]
        return {"node": np.repeat(np.array(rows["node"], np.int64), [len(s) for s in sets]), "h": np.concatenate([np.zeros(0, np.int64), *sets])}

    def alike(rows: dict) -> dict:
        held = []
        for a, b in zip(rows["left"], rows["right"]):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            # Both are sorted sets: the smaller one is looked up in the larger.
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            at = np.searchsorted(b, a)
            same = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0
            held.append(same >= similarity * (len(a) + len(b) - same))
        keep = np.array(held, bool)
        return {c: pa.array(rows[c], pa.int64()).filter(pa.array(keep)) for c in ("u", "v")}

    found = written(batches(rows, marked, "doc_id long, text_hash long, node long, size long, sample array<long>"), "marked")
    once = found.select("node", F.explode("sample").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    lone = once.groupBy("node").agg(F.count("*").alias("lone"))
    named = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    nodes = found.groupBy("node").agg(F.min(named).alias("least"), F.min("size").alias("size"))
    nodes = written(nodes.hint("merge").join(lone.hint("merge"), "node", "left"), "nodes")
    asked = nodes.where((F.col("size") > 0) & (F.coalesce("lone", F.lit(0)) <= F.col("size") - least_shared))
    chosen = asked.select(F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash"))
    own = rows.hint("merge").join(chosen.hint("merge"), F.col("text_hash").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    # A row that repeats in id and text comes once more, to the same node.
    sets = batches(own.select("text"), hashed, "node long, fp long, hashes binary").groupBy("node").agg(F.min("hashes").alias("hashes"), F.min("fp").alias("fp"))
    sets = written(sets, "shingles")

    tokens = batches(sets.select("node", "hashes"), spread, "node long, h long")
    shared = tokens.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    held = tokens.hint("merge").join(shared.hint("rebalance").hint("merge"), "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("held"))
    held = held.hint("merge").join(sets.select("node", "fp", (F.length("hashes") / 8).cast("long").alias("size")).hint("merge"), "node")
    # Shingles of one node alone come first in the order.
    held = held.withColumn("alone", F.col("size") - F.size("held")).withColumn("prefix", F.col("size") - least_shared + 1 - F.col("alone")).where("prefix > 0")
    held = held.withColumn("rank", F.struct((F.col("alone") / F.col("size")).alias("share"), F.xxhash64("node").alias("mixed")))
    entries = held.select("node", "fp", "size", "alone", "rank", F.posexplode(F.slice("held", F.lit(1), F.col("prefix").cast("int"))).alias("place", "token"))
    entries = written(entries.select(F.col("token.h").alias("h"), "node", "fp", "size", "rank", F.col("place").alias("place"), (F.col("size") - F.col("alone") - F.col("place")).alias("room")), "prefixes")

    def possible(size: str, room: str, of: str, room_of: str) -> Column:
        sizes = F.least(size, of) + 1e-9 >= similarity * F.greatest(size, of)
        return sizes & (F.least(room, room_of) * (1 + similarity) + 1e-6 >= similarity * (F.col(size) + F.col(of)))

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        pairs = written(pairs.distinct(), "candidates")
        left, right = (sets.select(F.col("node").alias(n), F.col("hashes").alias(side)) for n, side in (("u", "left"), ("v", "right")))
        both = pairs.hint("merge").join(left.hint("merge"), "u").hint("merge").join(right.hint("merge"), "v").select("u", "v", "left", "right")
        out = written(batches(both, alike, "u long, v long"), label)
        discard(pairs)
        return out

    ordered = lambda pairs: pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"))
    led = entries.groupBy("h").agg(F.min_by(F.struct(F.col("node").alias("other"), F.col("size").alias("of"), F.col("room").alias("room_of")), F.struct("rank", "node")).alias("leader"), F.count("*").alias("n")).where("n > 1").select("h", "leader")
    led = entries.hint("merge").join(led.hint("rebalance").hint("merge"), "h").select("node", "size", "room", "leader.*")
    led = ordered(led.where((F.col("node") != F.col("other")) & possible("size", "room", "of", "room_of")))
    links = linked(bucket_leaders(entries.where("place = 0").select("node", "fp", "rank"), distance).union(led), "led")

    reached = components(links, "near")
    parted = entries.select("h", "node", "size", "rank", "room").hint("merge").join(reached.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    parted = written(parted, "parted")
    mixed = parted.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", F.struct("rank", "node")).alias("main")).where("low < high").select("h", "main")
    # Of each shingle's nodes only those outside its leader's part look at the others.
    asking = parted.hint("merge").join(mixed.hint("rebalance").hint("merge"), "h").where("part <> main").select("h", "node", "size", "room", "part")
    asking = written(asking, "asking")
    others = parted.select("h", F.col("node").alias("other"), F.col("size").alias("of"), F.col("room").alias("room_of"), F.col("part").alias("part_of"))
    rest = asking.hint("merge").join(others.hint("merge"), "h").where((F.col("part") != F.col("part_of")) & possible("size", "room", "of", "room_of"))
    more = linked(ordered(rest), "rest")
    reached = components(links.union(more), "near")

    parts = nodes.hint("merge").join(reached.hint("merge"), "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    first = parts.groupBy("part").agg(F.min("least").alias("first"))
    groups_of = parts.select("node", "part").hint("merge").join(first.hint("rebalance").hint("merge"), "part").select("node", "first")
    out = found.select("doc_id", "text_hash", "node").hint("merge").join(groups_of.hint("merge"), "node")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    discard(sets, entries, parted, asking, links, more)
    return out.select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_digest(documents: DataFrame) -> DataFrame:
    return simhash_groups(documents).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
