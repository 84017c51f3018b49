"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments only. Of two fingerprints that differ in at most two bits, one segment
differs in at most one, so both write the same variant of it with that one bit left out. All variants with one bit
left out are the index; equal variants meet in an equality join and the full fingerprints are compared.

A variant that very many fingerprints share is not paired off: within it, the half not yet used is cut into two
segments in its turn (16 bits, then 8, 4, 2), which bounds what is left of a bucket by the few bits still free. So no
link is lost and no bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberglass.llm.text import map_batches, spans, texts, words
from emberglass.operators.components import connected_components
from emberglass.storage import Scratch

#: Buckets with more members are cut again.
BUCKET = 128
#: Bits in which linked fingerprints differ at most. The index is built for this number.
BITS = 2
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash64(text: bytes, n_words: int = 3) -> int:
    """The fingerprint: a bit is 1 if set in over half of the shingles' XXH64 (seed 42); no words give zero."""
    joined, starts, ends = spans(words(text), n_words)
    total, digest = len(starts), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])
        h = np.array([digest(joined[a:b], 42) for a, b in part], dtype=np.uint64)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3) -> DataFrame:
    """Rows (doc_id long, fp long: the fingerprint's bits) for every row of docs."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_signed(simhash64(t, n_words)) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, fp long")


def _cuts(width: int) -> list[tuple[int, int, int]]:
    """(rest, mask, new rest) for each range of 2*width bits that may still be free: a half less one bit, and the other half."""
    out = []
    for lo in range(0, 64, 2 * width):
        halves = [((1 << width) - 1) << lo, ((1 << width) - 1) << (lo + width)]
        for half, other in (halves, halves[::-1]):
            out += [(_signed(halves[0] | halves[1]), _signed(half & ~(1 << bit)), _signed(other)) for bit in range(64) if half >> bit & 1]
    return out


def _variants(members: DataFrame, width: int) -> DataFrame:
    table = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(m).alias("m"), F.lit(o).alias("o")) for r, m, o in _cuts(width)])
    hit = F.explode(F.filter(table, lambda x: x["r"] == F.col("rest")))
    cut = members.select("fp", "mask", hit.alias("c"))
    mask = F.col("mask").bitwiseOR(F.col("c.m"))
    return cut.select("fp", mask.alias("mask"), F.col("fp").bitwiseAND(mask).alias("value"), F.col("c.o").alias("rest"))


def _sizes(variants: DataFrame) -> DataFrame:
    """(mask, value, n, src, dst) of the buckets with two members or more: how many, the least and the greatest. Only
    partial aggregates are shuffled, so a bucket that very many share is counted by all tasks."""
    size = variants.groupBy("mask", "value").agg(F.count("*").alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"))
    return size.filter("n > 1")


def _apart(bits: int) -> Column:
    return (F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits)


def chains(distinct: DataFrame, bits: int) -> DataFrame:
    """Some pairs (src, dst) of different fingerprints (column fp, each once) that differ in at most bits bits: the least
    and the greatest of every bucket of the index. Other pairs are left to the caller."""
    members = distinct.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(-1).cast("long").alias("rest"))
    return _sizes(_variants(members, 32)).select("src", "dst").filter(_apart(bits)).distinct()


def links(distinct: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """Pairs (src, dst) of different fingerprints (column fp, each once) that differ in at most BITS bits.

    Buckets of two give their pair at once; those of up to bucket members are joined with themselves; larger ones are cut
    again. The join that finds the members of the larger buckets can be split where one is hot. No row gives no pair.
    """
    members = distinct.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(-1).cast("long").alias("rest"))
    found, width = [], 32
    while True:
        last = width == 2
        variants = _variants(members, width)
        sizes = scratch.save(_sizes(variants), f"sizes-{width}")
        found.append(sizes.filter("n = 2").select("src", "dst").filter(_apart(BITS)))
        more = sizes.filter("n > 2").select("mask", "value", "n")
        if more.isEmpty():
            break
        # the buckets grow with the input, so they are not broadcast at any size
        shared = scratch.save(variants.join(more.hint("merge"), ["mask", "value"]), f"shared-{width}")
        small = shared if last else shared.filter(F.col("n") <= bucket)
        a, b = small.select("mask", "value", F.col("fp").alias("src")), small.select("mask", "value", F.col("fp").alias("dst"))
        found.append(scratch.save(a.join(b, (a["mask"] == b["mask"]) & (a["value"] == b["value"]) & (F.col("src") < F.col("dst")) & _apart(BITS)).select("src", "dst").distinct(), "links"))
        members = shared.filter(F.col("n") > bucket).select("fp", "mask", "rest")
        if last or members.isEmpty():
            break
        width //= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3) -> DataFrame:
    """One row per row of docs: doc_id long, fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest doc_id reachable over links of at most BITS differing bits; n_links counts the other
    fingerprints that this one links to. Equal fingerprints (copies, empty and null texts, repeated rows) are one node
    of the graph and are never paired off. Null ids are kept and never name a component unless all its ids are null.
    Other columns of docs are not looked at. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.save(fingerprints(docs, id_col, text_col, n_words), "docs")
    nodes = scratch.save(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    edges = scratch.save(links(nodes, scratch), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    member = connected_components(edges, scratch).withColumnRenamed("node", "fp").join(ends, "fp")
    member = scratch.save(nodes.join(member, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "members")
    heads = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(heads, "root").select("fp", "component_id", "n_links")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return each.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "n_links")


#: For keep_one(): seed of the fingerprint over a text's distinct words, and the bits in which candidates differ.
SEED, CANDIDATE_BITS = 42, 14


def _word_set_fp(found: set[bytes], seed: int) -> int:
    if not found:
        return 0
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in found], dtype=np.uint64)
    counts = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big"))


#: Shingles that are known to be frequent, at most; texts from whose shingles they are got, about; places of a bitmap of
#: the texts whose shingles are fetched.
FREQUENT, SAMPLED, SLOTS = 1 << 16, 4096, 1 << 20


def _grams(text: bytes, n_words: int) -> np.ndarray:
    """Hashes of the different n_words-word shingles, ascending."""
    joined, starts, ends = spans(words(text), n_words)
    return np.array(sorted({_signed(xxhash.xxh64_intdigest(joined[x:y], 7)) for x, y in zip(starts, ends)}), np.int64)


def _parities(grams: np.ndarray, bits: int = 1024) -> list[int]:
    """bits bits in numbers of 64: whether oddly many hashes fall on each. Two sets differ in as many hashes as bits, at least."""
    odd = np.bincount(grams & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _fine(grams: np.ndarray) -> list[int]:
    """Parities on two to four bits a hash, a power of two; empty where 1024 are as many."""
    bits = 1 << (2 * len(grams) - 1).bit_length() if len(grams) else 0
    return _parities(grams, bits) if bits > 1024 else []


def _differ(a: str, b: str) -> Column:
    """In how many bits two parities differ, the longer folded to the length of the shorter; 0 where one is empty."""
    short = F.least(F.size(a), F.size(b))

    def folded(c: str) -> Column:
        at = lambda j: F.sequence(j, F.size(c) - 1, short)
        whole = lambda: F.transform(F.sequence(F.lit(0), short - 1), lambda j: F.aggregate(at(j), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(c, k))))
        return F.when(F.size(c) == short, F.col(c)).otherwise(whole())

    both = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when(short > 0, F.aggregate(both, F.lit(0), lambda k, n: k + n)).otherwise(0)


def _prefix(g: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """A text's first shingles in one order for all texts, frequent ones last, as many as any two texts that share
    similarity of their shingles need to have one in common. No shingles give one of their own."""
    if not len(g):
        return np.zeros(1, np.int64)
    known, times = frequent
    at = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
    n = np.where(known[at] == g, times[at], 0) if len(known) else np.zeros(len(g), np.int64)
    first = len(g) - int(np.ceil(similarity * len(g) - 1e-9)) + 1
    return g[np.lexsort((g, n))[:first]]


def _frequent(rows: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, times) of the FREQUENT most frequent shingles in about SAMPLED of the texts. Only an order depends on it."""
    part = rows.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, rows.count() // SAMPLED))) == 0).select("text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [np.zeros(0, np.int64), *(_grams(t, n_words) for t in texts(batch.column(0)))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams), pa.int64())], ["gram"])

    often = map_batches(part, each, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter("n > 2")
    found = often.orderBy(F.desc("n"), "gram").limit(FREQUENT).orderBy("gram").collect()
    return tuple(np.array([r[k] for r in found], np.int64) for k in (0, 1))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the least id (null ids last).

    Texts are linked if they share at least similarity of their n_words-word shingles (as sets). Equal texts are one
    node. Texts without words are alike; a null is the empty text. Rows with equal id and text are one document. All
    columns are kept.

    No linked pair is lost. Two such texts have a shingle in common among the first of each (see _prefix), so all pairs
    that meet there are candidates, but for those already in one group, which a further link would not change. To have
    few left, groups are first made of part of the pairs, in number proportional to the texts: of those that the
    deletion-variant index over SimHashes of the texts' distinct words finds (these move less under small edits than
    SimHashes of shingles do), and of each text with the least one it meets. All candidates are verified on whole texts.

    Texts go through Python once for their marks and first shingles; whole sets of shingles are got again only for texts
    in candidate pairs, told by a bitmap of SLOTS places, which is all that is broadcast. Texts are shuffled once, at the
    end.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("node")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(digest, F.col(id_col).cast("long").alias("doc_id"), text)
    frequent = _frequent(rows, n_words)

    def prints(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = texts(batch.column(2))
        grams = [_grams(t, n_words) for t in known]
        fps = pa.array([_word_set_fp(set(words(t)), SEED) for t in known], pa.int64())
        sizes, odd = pa.array([len(g) for g in grams], pa.int32()), pa.array([_parities(g) for g in grams], pa.list_(pa.int64()))
        fine = pa.array([_fine(g) for g in grams], pa.list_(pa.int64()))
        first = pa.array([_prefix(g, frequent, similarity) for g in grams], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, sizes, odd, fine, first], ["node", "doc_id", "fp", "size", "odd", "fine", "first"])

    def gram_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_grams(t, n_words) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "grams"])

    def slot(node: str, doc_id: str) -> Column:
        return F.pmod(F.xxhash64(node, doc_id), F.lit(SLOTS)).alias("slot")

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked pairs (src, dst) among pairs (a, b). Sets that must differ too much to be linked are not fetched: by
        1024 parities a text for all pairs, then for those left by as many as long texts need, a thirtieth of their sets."""
        a, b = (nodes.select(F.col("node").alias(c), F.col("doc_id").alias(f"i{c}"), F.col("size").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
        few = lambda x, y: _differ(x, y) * (1 + similarity) <= (F.col("na") + F.col("nb")) * (1 - similarity) + 1e-6
        may = (F.greatest("na", "nb") * similarity - 1e-6 <= F.least("na", "nb")) & few("oa", "ob")
        pairs = scratch.save(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").filter(may).select("a", "b", "ia", "ib", "na", "nb"), "near")
        a, b = (nodes.select(F.col("node").alias(c), F.col("fine").alias(f"f{c}")) for c in "ab")
        pairs = scratch.save(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").filter(few("fa", "fb")).select("a", "b", "ia", "ib"), "nearer")
        wanted = pairs.select(slot("a", "ia")).union(pairs.select(slot("b", "ib"))).distinct()  # SLOTS rows at most
        chosen = rows.withColumn("slot", slot("node", "doc_id")).join(F.broadcast(wanted), "slot", "left_semi").select("node", "text")
        sets = scratch.save(map_batches(chosen, gram_sets, "node string, grams array<long>").dropDuplicates(["node"]), "grams")
        a, b = sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        share = F.when(F.size("x") + F.size("y") == 0, 1.0).otherwise(shared / (F.size("x") + F.size("y") - shared))
        linked = scratch.save(pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").filter(share >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst")), "linked")
        scratch.drop(sets)
        return linked

    each = map_batches(rows, prints, "node string, doc_id long, fp long, size int, odd array<long>, fine array<long>, first array<long>")
    each = scratch.save(each.withColumn("nid", F.xxhash64("node")), "prints")
    nodes = scratch.save(each.groupBy("node", "nid").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "size", "odd", "fine")]), "nodes")
    heads = scratch.save(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = nodes.join(heads.hint("merge"), "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = chains(heads.select("fp"), CANDIDATE_BITS)
    a, b = heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), heads.select(F.col("fp").alias("dst"), F.col("head").alias("b"))
    pairs = same.union(near.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("a", "b")).filter("a <> b")

    meet = Window.partitionBy("gram")
    order = meet.orderBy("nid", "pos")
    least = F.first(F.struct("nid", "size", "pos")).over(order).alias("h")
    shared = each.select("nid", "size", F.posexplode("first").alias("pos", "gram"))
    shared = shared.select("gram", "nid", "size", "pos", least, F.lag("nid").over(order).alias("before"), F.lead("nid").over(order).alias("after"))
    # one row of each text, of texts that meet another
    shared = shared.filter("(before is null and after <> nid) or before <> nid or (h.nid = nid and before = nid and after <> nid)").drop("before", "after")
    shared = scratch.save(shared.dropDuplicates(["gram", "nid"]), "shared")
    scratch.drop(each)

    def enough(size0: Column, pos0: Column, size1: Column, pos1: Column) -> Column:
        """At their first common shingle, two linked texts have enough shingles from there on."""
        return F.least(size0 - pos0, size1 - pos1) * (1 + similarity) >= (size0 + size1) * similarity - 1e-6

    def named(found: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("nid").alias("m"), F.col("node").alias("a")), nodes.select(F.col("nid").alias("n"), F.col("node").alias("b"))
        return found.distinct().join(a.hint("merge"), "m").join(b.hint("merge"), "n").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    first = shared.filter((F.col("h.nid") != F.col("nid")) & enough(F.col("h.size"), F.col("h.pos"), F.col("size"), F.col("pos")))
    pairs = pairs.union(named(first.select(F.col("h.nid").alias("m"), F.col("nid").alias("n"))))
    pairs = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    linked = verified(pairs)
    groups = scratch.save(nodes.join(connected_components(linked, scratch).hint("merge"), "node", "left").select("nid", F.xxhash64(F.coalesce("component", "node")).alias("root")), "groups")
    rooted = shared.drop("h").join(groups.hint("merge"), "nid")
    apart = rooted.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("gram")
    open_ = scratch.save(rooted.join(apart.hint("merge"), "gram"), "open")
    scratch.drop(shared)
    x, y = (open_.select("gram", *[F.col(c).alias(f"{c}{k}") for c in ("nid", "size", "pos", "root")]) for k in (0, 1))
    fit = (x["gram"] == y["gram"]) & (F.col("nid0") < F.col("nid1")) & (F.col("root0") != F.col("root1")) & enough(F.col("size0"), F.col("pos0"), F.col("size1"), F.col("pos1"))
    rest = scratch.save(named(x.join(y, fit).select(F.col("nid0").alias("m"), F.col("nid1").alias("n"))).join(pairs, ["a", "b"], "left_anti"), "rest")
    linked = linked.union(verified(rest))
    member = nodes.join(connected_components(linked, scratch), "node", "left").select(F.coalesce("component", "node").alias("root"), "node", "doc_id")
    best = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("b"))

    def key(node: str | Column, doc_id: Column) -> Column:
        return F.concat(node, F.lit(":"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))).alias("key")

    kept = scratch.save(best.select(key(F.col("b.node"), F.col("b.doc_id"))), "kept")
    whole = docs.select(key(digest, F.col(id_col)), F.struct("*").alias("row"))  # no name of docs can clash
    # what is kept grows with the input, so it isn't broadcast; both sides and the last step go by the same key
    return whole.join(kept.hint("merge"), "key").dropDuplicates(["key"]).select("row.*")
