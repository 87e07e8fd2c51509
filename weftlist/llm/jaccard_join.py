"""N-gram Jaccard join with PartEnum signatures.

Sets are the distinct word shingles of whole texts. Sizes fall into bands whose upper end is 4/3
of the lower; sets of similarity 0.75 lie in the same band or in neighbouring ones, so every set
joins the family of its band and that of the next. Sets of one band meet in its own family, so a signature
that only sets of the band below have is not listed. A family splits the shingle domain into
partitions and each of these into three second-level ones. Two linked sets differ in at most
k = (|A|+|B|)/7 shingles, and there are more than k / 2 partitions, so in some partition they differ in
one shingle at most: there one subset of two second-level partitions holds exactly the same in both.
The hashes of these subsets' contents are the signatures. How many of them a link must share follows
from the set's own partitions (``signatures``). Shingles that very many documents have are left out
of the partitions, which can only bring two sets closer. A set that this leaves without a certain
signature also takes part in a split of all its shingles, failing there in a finer one, and at last in
one with a partition for each shingle.

Signatures travel as packed bytes, a row for each map block and bucket, and meet in buckets of
bounded size. A set that must share t signatures may leave out its t - 1 most frequent ones: of the
signatures that two linked sets share, the rarest is still kept by both. What meets in the kept
signatures forms a cluster around the member whose signatures are the most frequent, so the
signatures of a group of near copies mostly name the same cluster. Members are compared with their
cluster's centre on whole sets, and the links joined into components. Only in clusters that then hold
several components the members outside the centre's component are compared with the others, in
tiles of bounded size that give a spanning forest of the links found and no other pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlist.llm.components import components
from weftlist.llm.tables import BROADCAST_IDS, keep, only_ids, parts, plan_bytes
from weftlist.llm.words import SPACED, U, Words, distinct_by_row, grams, lean, mix, release, text_slices

#: A signature of more documents than this is listed in runs and under its own name, not under its documents.
HOT = 64
#: Frequent shingles that signatures leave out, at most: 8 bytes each reach every task.
COMMON = 250_000
#: Shingles that a map task counts at a time, and signatures that it holds before it writes them out by bucket.
COUNTED = 4_000_000
BLOCK = 500_000
#: Bytes kept of a signature beside its bucket: meetings by chance are found out when sets are compared.
SIG_BYTES = 5
#: Distinct shingles of documents for each bucket of signatures, of which a set has about as many.
BUCKET_SHINGLES = 250_000
#: Sets, and their elements, on each side of a tile; elements found more often than DENSE in a tile are counted by matrix product.
TILE_SETS = 2048
TILE_ELEMENTS = 2_000_000
DENSE = 24
#: Bytes of sets on each side of a cell of pairs, pairs of a cell, and elements compared at a time.
CELL_BYTES = 16 << 20
CELL_PAIRS = 1_000_000
COMPARED = 2_000_000

_upper = [0]
while _upper[-1] < 2**31:
    _upper.append((_upper[-1] + 1) * 4 // 3)
UPPER = np.array(_upper, np.int64)
_SALTS = [U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)]


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes, row bounds) for slices of a text column."""
    for first, end, data, offs in text_slices(column):
        value, row, _ = grams(Words(data, offs, SPACED), width, short=True)
        yield first, *distinct_by_row(value, row, end - first)


def _set_keys(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sums = []
    for salt in _SALTS[:2]:
        total = np.zeros(len(value) + 1, U)
        np.cumsum(mix(value ^ salt), out=total[1:])
        sums.append(mix(total[bounds[1:]] - total[bounds[:-1]]))
    return sums[0], sums[1]


def _partitions(value, row, n1, k, family, level, rows):
    """(signature, row) of the non-empty subsets of each row, and how many of them a set within distance k shares for certain."""
    offs = np.concatenate([[0], np.cumsum(n1)])
    slot = (offs[row] + (value % n1[row].astype(U)).astype(np.int64)) * 3 + ((value >> U(40)) % U(3)).astype(np.int64)
    total = np.zeros(3 * offs[-1], U)
    np.add.at(total, slot, mix(value ^ _SALTS[2]))
    full = np.zeros(3 * offs[-1], bool)
    full[slot] = True
    total, full = total.reshape(-1, 3), full.reshape(-1, 3)
    held = full.sum(1)
    owner = np.repeat(np.arange(rows), n1)
    tag = family[owner].astype(U) * U(0x9E3779B97F4A7C15) + U(level * 0x52DCE729) + (np.arange(len(owner)) - offs[owner]).astype(U)
    # The subset without second-level partition j.
    at, j = np.nonzero((held[:, None] - full) > 0)
    sig = mix((total.sum(1, dtype=U)[at] - total[at, j]) ^ mix(tag[at] * U(3) + j.astype(U)))
    # A difference costs a partition two subsets; the next one costs the third, if there is one.
    some = np.bincount(owner[held > 0], minlength=rows)
    three = np.bincount(owner[held > 1], minlength=rows)
    certain = 2 * some + three - 2 * np.minimum(k, some) - np.minimum(np.maximum(k - some, 0), three)
    return sig, owner[at], certain


def signatures(value: np.ndarray, bounds: np.ndarray, common: np.ndarray, spread: float = 0.16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row), and for each row how many a linked set shares for certain and whether a finer level was needed."""
    sig, row, _, shared, deep = family_signatures(value, bounds, common, spread)
    return sig, row, shared, deep


def family_signatures(value: np.ndarray, bounds: np.ndarray, common: np.ndarray, spread: float = 0.16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, whether it is in the family of the next band), and for each row the counts and flags of ``signatures``."""
    size = np.diff(bounds)
    sigs, owners, uppers = [], [], []
    shared, deep = np.full(len(size), 2**30, np.int64), np.zeros(len(size), bool)
    band = np.searchsorted(UPPER, size)
    rare = np.ones(len(value), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] != value
    owner_of = np.repeat(np.arange(len(size)), size)
    for step in (0, 1):
        active = size > 0
        for level in range(4):
            rows = np.flatnonzero(active)
            if not len(rows):
                break
            n, place = size[rows], np.cumsum(active) - 1
            family = band[rows] + step
            top = UPPER[np.minimum(family, len(UPPER) - 1)]
            k = (n + np.minimum(n * 4 // 3, top)) // 7
            n1 = np.ceil(spread * top).astype(np.int64) + 2
            use = active[owner_of] & rare if level == 0 else active[owner_of]
            v, local = value[use], place[owner_of[use]]
            if level < 3:
                sig, owner, certain = _partitions(v, local, n1 * 4 + 3 if level == 2 else n1, k, family, level, len(rows))
            else:
                sig, owner, certain = mix(v ^ mix(family.astype(U) + U(1 << 40))[local]), local, n - k
            sigs.append(sig)
            owners.append(rows[owner])
            uppers.append(np.full(len(sig), step == 1))
            weak = certain <= 0
            shared[rows[~weak]] = np.minimum(shared[rows[~weak]], certain[~weak])
            deep[rows] |= level > 0
            active = np.zeros(len(size), bool)
            active[rows[weak]] = True
    if not sigs:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool), shared, deep
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(uppers), shared, deep


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles found in many documents, ascending; at most ``COMMON``.

    Map tasks count in blocks and report what repeats within a block; the counts are then added up.
    Any choice gives the same result, as long as all sets leave out the same shingles: it only
    decides how many signatures are shared by chance.
    """

    def counts(held):
        value = np.concatenate(held)
        value.sort()
        cut = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        n = np.diff(np.append(cut, len(value)))
        often = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(value[cut[often]].view(np.int64)), pa.array(n[often])], ["shingle", "n"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for _, value, _ in shingle_sets(batch.column(0), width):
                held.append(value)
                n += len(value)
                if n >= COUNTED:
                    yield counts(held)
                    held, n = [], 0
        if held:
            yield counts(held)

    found = docs.select("text").mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(f"n > {HOT}")
    top = found.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toArrow()
    return np.sort(top.column(0).to_numpy().view(U))


def set_table(docs: DataFrame, width: int, common) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, shared, deep) of every document."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_numpy(zero_copy_only=False), []
            for first, value, bounds in shingle_sets(batch.column(1), width):
                k1, k2 = _set_keys(value, bounds)
                _, _, shared, deep = signatures(value, bounds, common.value)
                out.append((np.diff(bounds), k1.view(np.int64), k2.view(np.int64), shared, deep))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*out))], ["doc_id", "n_shingles", "k1", "k2", "shared", "deep"])

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, k1 long, k2 long, shared long, deep boolean")


def _narrow(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max()
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _pack(sigs: list, docs: list, uppers: list, buckets: int) -> pa.RecordBatch:
    sig, doc, upper = np.concatenate(sigs), np.concatenate(docs), np.concatenate(uppers)
    bucket = (sig % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    sig, doc, upper, bucket = sig[order], doc[order], upper[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(sig))
    rest = np.ascontiguousarray((sig // U(buckets)).view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES])
    step = np.diff(doc, prepend=np.int64(0))
    step[cuts] = 0
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[cuts]),
        pa.array([rest[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        pa.array(doc[cuts]),
        pa.array([_narrow(step[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        pa.array([np.packbits(upper[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
    ], ["bucket", "sigs", "first", "steps", "upper"])


def _emit(width: int, buckets: int, common):
    def run(batches):
        seen, sigs, owners, uppers, held = set(), [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, value, bounds in shingle_sets(batch.column(1), width):
                keys = list(zip(*(x.tolist() for x in _set_keys(value, bounds))))
                fresh = np.zeros(len(keys), bool)
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                sig, row, upper, _, _ = family_signatures(value, bounds, common.value)
                use = fresh[row]
                sig, row, upper = sig[use], row[use], upper[use]
                order = np.argsort(row, kind="stable")
                sigs.append(sig[order])
                owners.append(ids[first + row[order]])
                uppers.append(upper[order])
                held += len(sig)
                if held >= BLOCK:
                    yield _pack(sigs, owners, uppers, buckets)
                    sigs, owners, uppers, held = [], [], [], 0
        if held:
            yield _pack(sigs, owners, uppers, buckets)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Groups of documents that share a signature, each once: ids ascending; of a hot one, runs that begin with its smallest id.

    A group that only has sets of the band below is left out: they are of one band and meet in its family.
    """
    sig, doc, upper = [], [], []
    for rest, first, step, above in zip(*(table.column(c).to_pylist() for c in ("sigs", "first", "steps", "upper"))):
        n = len(rest) // SIG_BYTES
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :SIG_BYTES] = np.frombuffer(rest, np.uint8).reshape(-1, SIG_BYTES)
        sig.append(wide.view(U).ravel())
        doc.append(first + np.cumsum(np.frombuffer(step, f"i{len(step) // n}"), dtype=np.int64))
        upper.append(np.unpackbits(np.frombuffer(above, np.uint8), count=n))
    sig, doc, upper = np.concatenate(sig), np.concatenate(doc), np.concatenate(upper)
    order = np.argsort(sig, kind="stable")
    sig, doc, upper = sig[order], doc[order], upper[order]
    cut = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    length = np.diff(np.append(cut, len(sig)))
    own = np.minimum.reduceat(upper, cut) == 0
    cut, length = cut[own], length[own]
    out_sig, out_ids, out_weight, out_size, known = [], [], [], [], {}
    for a, n in zip(cut[length > 1], length[length > 1]):
        ids = np.unique(doc[a : a + n])
        if len(ids) < 2:
            continue
        key = ids.tobytes() if len(ids) <= HOT else None
        if key is not None:
            if key not in known:
                known[key] = len(out_ids)
                out_sig.append(None)
                out_ids.append(ids)
                out_weight.append(0)
                out_size.append(len(ids))
            out_weight[known[key]] += 1
            continue
        for i in range(1, len(ids), 1000):
            out_sig.append(int(sig[a : a + 1].view(np.int64)[0]))
            out_ids.append(np.append(ids[:1], ids[i : i + 1000]))
            out_weight.append(1)
            out_size.append(len(ids))
    del sig, doc, upper, order, cut, length, own, known
    release()
    return pa.table({"hot": pa.array(out_sig, pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out_sig), pa.int32()), "ids": pa.array(out_ids, pa.list_(pa.int64())), "weight": pa.array(out_weight, pa.int64()), "size": pa.array(out_size, pa.int64())})


def similar(value: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of set numbers (a, b), ordered by a, are similar enough; a set's elements are value[bounds[i]:bounds[i + 1]]."""
    code = np.unique(value, return_inverse=True)[1]
    size, mark = np.diff(bounds), np.zeros(len(value) + 1, bool)
    good = np.zeros(len(a), bool)
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(a))):
        own = code[bounds[a[low]] : bounds[a[low] + 1]]
        mark[own] = True
        while low < high:
            # Partners whose elements together are about COMPARED, one at least.
            total = np.cumsum(size[b[low:high]])
            end = low + max(1, int(np.searchsorted(total, COMPARED, "right")))
            part = b[low:end]
            flat = mark[np.concatenate([code[bounds[i] : bounds[i + 1]] for i in part])]
            shared = np.add.reduceat(flat, np.append(0, total[: end - low - 1]), dtype=np.int64)
            good[low:end] = 100 * shared >= percent * (len(own) + size[part] - shared)
            low = end
        mark[own] = False
    return good


def _compare(percent: int):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = sets.column("grams").cast(pa.large_binary()).combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        _, offsets, data = held.buffers()
        offs = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
        value = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].copy().view(np.int64)
        ids = sets.column("doc_id").to_numpy()
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy())] for c in ("a", "b"))
        by = np.argsort(a, kind="stable")
        good = by[similar(value, (offs - offs[0]) // 8, a[by], b[by], percent)]
        return pairs.select(["a", "b"]).take(pa.array(good))

    return run


def set_rows(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, grams) of the documents in ``ids``: the set as packed 64-bit hashes, ascending."""

    def sets(batches):
        for batch in batches:
            for first, value, bounds in shingle_sets(batch.column(1), width):
                held = pa.array([value[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), held], ["doc_id", "grams"])

    return keep(only_ids(docs, ids).mapInArrow(lean(sets), "doc_id long, grams binary").dropDuplicates(["doc_id"]), "grams")


def verified(pairs: DataFrame, grams_of: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) of documents whose whole shingle sets are similar enough.

    Pairs are dealt into cells by the hashes of both documents, and a set goes once to each cell that has a pair
    of it, so the members of a large group are not sent once for every partner.
    """
    side = max(parts(pairs.sparkSession) ** 0.5, plan_bytes(grams_of) / CELL_BYTES, (pairs.count() / CELL_PAIRS) ** 0.5)
    side = int(-(-side // 1))
    cells = pairs.select(F.expr(f"pmod(xxhash64(a), {side}) * {side} + pmod(xxhash64(b), {side})").alias("cell"), "a", "b")
    wanted = cells.select("cell", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    placed = wanted.join(grams_of, "doc_id").select(F.col("cell").alias("at"), "doc_id", "grams")
    return keep(cells.groupBy("cell").cogroup(placed.groupBy("at")).applyInArrow(_compare(percent), "a long, b long"), "links")


def shared_counts(value: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right``, both lists of set numbers."""
    size = np.diff(bounds)
    code, times = np.unique(value, return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(size)), size)
    place = np.full((2, len(size)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    dense = np.flatnonzero(times > DENSE)
    number = np.full(len(times), -1)
    number[dense] = np.arange(len(dense))
    column = number[code]
    for low in range(0, len(dense), 2048):
        use = (column >= low) & (column < low + 2048)
        sides = []
        for p, n in zip(place, out.shape):
            own = use & (p[owner] >= 0)
            m = np.zeros((n, min(2048, len(dense) - low)), np.float32)
            m[p[owner[own]], column[own] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    seldom = np.flatnonzero((column < 0) & (times[code] > 1))
    seldom = seldom[np.argsort(code[seldom], kind="stable")]
    c, o = code[seldom], owner[seldom]
    for step in range(1, DENSE):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        for x, y in ((o[same], o[same + step]), (o[same + step], o[same])):
            i, j = place[0, x], place[1, y]
            both = (i >= 0) & (j >= 0)
            np.add.at(out.ravel(), i[both] * len(right) + j[both], np.float32(1))
    return out


def forest(good: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links out of the matrix ``good`` that join what it joins of the labelled sets, none within a label."""
    label, out = label.copy(), []
    while True:
        good &= label[left][:, None] != label[right][None, :]
        some = np.flatnonzero(good.any(1))
        if not len(some):
            return out
        for i, j in zip(left[some], right[good[some].argmax(1)]):
            if label[i] != label[j]:
                out.append((i, j))
                label[label == label[j]] = label[i]


def _tiles(percent: int):
    """Rows arrive by tile; a tile's links between components are found in one matrix of shared counts."""

    def links(held):
        first, second = np.array([x[3] for x in held]), np.array([x[4] for x in held])
        size = np.array([len(x[2]) // 8 for x in held])
        value = np.frombuffer(b"".join(x[2] for x in held), np.int64)
        left, right = np.flatnonzero(first), np.flatnonzero(second)
        shared = shared_counts(value, np.concatenate([[0], np.cumsum(size)]), left, right)
        good = np.zeros(shared.shape, bool)
        for low in range(0, len(left), 256):  # whole numbers of 8 bytes, a few rows at a time
            part = slice(low, low + 256)
            good[part] = (100 + percent) * shared[part].astype(np.int64) >= percent * (size[left[part]][:, None] + size[right][None, :])
        label = np.unique(np.array([x[1] for x in held]), return_inverse=True)[1]
        return [(held[i][0], held[j][0]) for i, j in forest(good, left, right, label)]

    def run(batches):
        held, last = [], None
        for batch in batches:
            out = []
            for tile, rep, component, grams, first, second in zip(*(batch.column(c).to_pylist() for c in ("tile", "rep", "component", "grams", "first", "second"))):
                if tile != last and held:
                    out += links(held)
                    held = []
                last = tile
                held.append((rep, component, grams, first, second))
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        if held:
            out = links(held)
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [y for _, y in out]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def tiled_links(rows: DataFrame, grams_of: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each cluster, from rows (c, rep, n, component, main); ``main`` is the component of c.

    Members outside the main component are dealt into blocks, and so are those inside; a tile takes two of the
    outer blocks, or an outer and an inner one.
    """
    blocks = f"int(ceil(greatest(count_if({{0}}) / {TILE_SETS}, sum(if({{0}}, n, 0)) / {TILE_ELEMENTS})))"
    sizes = rows.groupBy("c").agg(F.expr(blocks.format("component <> main")).alias("nl"), F.expr(blocks.format("component = main")).alias("nm")).where("nl > 0")
    sizes = keep(sizes, "sizes")
    if sizes.count() <= BROADCAST_IDS // 4:  # members of a large cluster then stay spread over all tasks
        sizes = F.broadcast(sizes)
    rows = rows.join(sizes, "c").withColumn("outer", F.expr("component <> main"))
    rows = rows.withColumn("block", F.expr("int(pmod(xxhash64(rep, 7), if(outer, nl, nm)))"))
    rows = rows.withColumn("x", F.explode(F.expr("if(outer, sequence(0, nl + nm - 1), sequence(0, nl - 1))")))
    rows = rows.select("rep", "component", F.expr("""case
        when not outer then struct(c, true as inner, x as i, block as j)
        when x < nl then struct(c, false as inner, least(block, x) as i, greatest(block, x) as j)
        else struct(c, true as inner, block as i, x - nl as j) end""").alias("t"), "outer", "block")
    rows = rows.select(F.expr("xxhash64(t.c, t.inner, t.i, t.j)").alias("tile"), "rep", "component", F.expr("outer and (t.inner or block = t.i)").alias("first"), F.expr("if(t.inner, not outer, block = t.j)").alias("second"))
    rows = rows.join(grams_of.withColumnRenamed("doc_id", "rep"), "rep")
    spark = rows.sparkSession
    rows = rows.repartition(parts(spark), "tile").sortWithinPartitions("tile")
    return keep(rows.mapInArrow(lean(_tiles(percent)), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A text of fewer words
    than ``width`` is one shingle; a null or blank text has none, links with nothing and is its own
    component. Two documents link when 100 * intersection >= percent * union; component_id is the
    smallest id reachable. Repeated rows give repeated results; of rows that share an id but not the text,
    one text stands for the id; rows of a null id are returned with a null component. ``percent`` must be at
    least 75, for which the bands are laid out. Other columns of ``docs`` are ignored.
    """
    if percent < 75:
        raise ValueError("the size bands hold for a similarity of 0.75 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(docs, width))
    info = keep(set_table(docs, width, common), "sets")
    again = not info.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").isEmpty()
    named = info.where("doc_id is not null and n_shingles > 0")
    same = named.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = keep(named.join(same.where("copies > 1"), ["k1", "k2", "n_shingles"]).select("doc_id", "rep").distinct(), "copies")

    # By what has been counted: file sizes say little where texts compress well, and nothing for tables without files.
    shingles = same.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(parts(spark), -(-shingles // BUCKET_SHINGLES))
    # Copies meet anyway, under one name, but a list of them that is small enough to broadcast saves their signatures.
    emitting, spare = docs.where("doc_id is not null"), copies.where("doc_id <> rep").select("doc_id").distinct()
    if not again and spare.count() <= BROADCAST_IDS:
        emitting = emitting.join(F.broadcast(spare), "doc_id", "left_anti")
    packed = emitting.mapInArrow(lean(_emit(width, buckets, common)), "bucket int, sigs binary, first long, steps binary, upper binary")
    met = packed.groupBy("bucket").applyInArrow(_meet, "hot long, bucket int, ids array<long>, weight long, size long")
    met = keep(met, "met")

    # Documents by signature; signatures of the very same documents are one group of greater weight.
    sets = named.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.min(F.expr("if(deep, 1, shared)")).alias("need")).join(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    groups = met.where("hot is null").groupBy("ids").agg(F.sum("weight").alias("w"), F.max("size").alias("size")).select(F.xxhash64("ids").alias("g"), F.explode("ids").alias("doc_id"), "w", "size")
    groups = groups.unionAll(met.where("hot is not null").select(F.xxhash64("hot", "bucket", F.lit("hot")), F.explode("ids"), F.lit(1).cast("long"), "size").distinct())
    members = groups.join(sets, "doc_id").groupBy("rep", "g").agg(F.max("w").alias("w"), F.max("size").alias("size"), F.min("need").alias("need"), F.max("n").alias("n"))
    own = Window.partitionBy("rep")
    members = members.withColumn("seen", F.sum("w").over(own.orderBy(F.desc("size"), "g"))).withColumn("held", F.sum("w").over(own)).withColumn("height", F.sum(F.col("w") * F.col("size")).over(own))
    members = keep(members.where("held >= need and seen >= need").select("g", "rep", "n", "height"), "members")
    centre = members.groupBy("g").agg(F.max(F.struct("height", "rep", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    clusters = members.join(centre, "g").groupBy(F.col("c.rep").alias("c"), "rep").agg(F.max("n").alias("n"), F.max("c.n").alias("n_c"))
    clusters = keep(clusters, "clusters")

    grams_of = set_rows(docs, clusters.select(F.col("rep").alias("doc_id")).distinct(), width)
    links = verified(clusters.where(f"rep <> c and 100 * least(n, n_c) >= {percent} * greatest(n, n_c)").select(F.col("c").alias("a"), F.col("rep").alias("b")), grams_of, percent)
    reached = components(links)
    at = reached.select(F.col("id").alias("rep"), "component")
    main = reached.select(F.col("id").alias("c"), F.col("component").alias("main"))
    rows = clusters.join(at, "rep", "left").join(main, "c", "left").select("c", "rep", "n", F.coalesce("component", "rep").alias("component"), F.coalesce("main", "c").alias("main"))
    linked = components(links.unionAll(tiled_links(keep(rows, "placed"), grams_of, percent)))
    out = info.select("doc_id", "n_shingles").join(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    return out.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
