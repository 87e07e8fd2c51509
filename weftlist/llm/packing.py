"""Best-fit packing by bin-completion branch-and-bound.

Texts are tokenized once. Only the piece lengths matter for packing, and there are at most as many
of these as the capacity: the driver plans on a histogram of bounded size. Best-fit decreasing and the fillings of least
waste in turn give the incumbent. If it has more sequences than the lower bound, the undominated fillings around the largest
length left are branched over, with the waste of the whole packing as the bound. This search ends after ``WORK``
steps; the incumbent is then used, which need not be the fewest sequences. The plan is
a list of rank ranges for each length, and pieces are assigned by their rank within their length,
which comes from counts by partition, never from one global sort.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlist.llm.tables import keep
from weftlist.llm.words import U, _SALT, _powers, lean, mix

#: Pieces of text whose ids a worker keeps; code points that it encodes at once.
CACHE_PIECES = 500_000
SLICE_CHARS = 1 << 20
#: Steps of the search for fewer sequences; a filling that is looked at counts as many as there are lengths.
WORK = 4_000_000


def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 0 other, for every code point, as the pre-tokenizer's pattern sees it."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, what in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        found = regex.findall(what, every)
        table[np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)] = k
    return table


def split_words(codes: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokenizer's pieces in the concatenated code points of texts; ``starts`` are the texts' first ones.

    The pattern is: contractions, then runs of letters, numbers or others with one optional blank
    before them, then white space, whose last character stays apart if something follows.
    """
    n = len(codes)
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    text = np.zeros(n, bool)
    text[starts[starts < n]] = True
    cut |= text
    space = kind == 3
    follows = np.zeros(n, bool)  # a character that is not white space follows in the same text
    follows[:-1] = ~space[1:] & ~text[1:]
    last = space & follows
    cut |= last
    blank = last & (codes == 32)
    after = np.flatnonzero(blank) + 1
    cut[after] = False
    quote = np.flatnonzero((codes == 39) & cut)
    if len(quote):
        c = [np.where((quote + j < n), codes[np.minimum(quote + j, n - 1)], 0) for j in (1, 2)]
        same1 = (quote + 1 < n) & ~text[np.minimum(quote + 1, n - 1)]
        same2 = same1 & (quote + 2 < n) & ~text[np.minimum(quote + 2, n - 1)]
        one = same1 & np.isin(c[0], [ord(x) for x in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= same2 & (c[0] == ord(a)) & (c[1] == ord(b))
        for at, width in ((quote[one], 2), (quote[two & ~one], 3)):
            cut[at + 1] = False
            end = at + width
            end = end[end < n]
            cut[end] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of whole texts. Equal pieces are encoded once; the cache of pieces is bounded."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kinds = _classes()
        self.known, self.slot = np.zeros(0, U), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(1 << 20, np.uint32), np.zeros(1, np.int64)
        self.rng = np.random.default_rng(7).integers(1, 2**63, 0x110000, dtype=np.int64).astype(U)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(m in text for m in self.marks):  # the tokenizer itself knows its own marks
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (size == 0 or size + len(texts[plain[end]]) <= SLICE_CHARS):
                size += len(texts[plain[end]])
                end += 1
            for i, ids in zip(plain[at:end], self._run([texts[i] for i in plain[at:end]])):
                out[i] = ids
            at = end
        return out

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(codes):
            return [np.zeros(0, np.uint32)] * len(texts)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = split_words(codes, self.kinds[codes], first[:-1])
        ends = np.append(starts[1:], len(codes))
        power, inverse = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, U)
        np.cumsum(self.rng[codes] * power[: len(codes)], out=sums[1:])
        key = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * _SALT[62])
        value, index, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self.known, self.slot, self.bounds = self.known[:0], self.slot[:0], self.bounds[:1]
        at = np.minimum(np.searchsorted(self.known, value), max(len(self.known) - 1, 0))
        there = self.known[at] == value if len(self.known) else np.zeros(len(value), bool)
        fresh = np.flatnonzero(~there)
        encoded = [self.fast.encode_ordinary(whole[a:b]) for a, b in zip(starts[index[fresh]].tolist(), ends[index[fresh]].tolist())]
        slots = np.empty(len(value), np.int64)
        slots[there] = self.slot[at[there]]
        slots[fresh] = len(self.bounds) - 1 + np.arange(len(fresh))
        if len(fresh):
            low, grown = self.bounds[-1], np.cumsum([len(x) for x in encoded]) + self.bounds[-1]
            while grown[-1] > len(self.ids):
                self.ids = np.append(self.ids, np.zeros_like(self.ids))
            self.ids[low : grown[-1]] = np.fromiter((i for x in encoded for i in x), np.uint32, int(grown[-1] - low))
            self.bounds = np.append(self.bounds, grown)
            place = np.searchsorted(self.known, value[fresh])
            self.known, self.slot = np.insert(self.known, place, value[fresh]), np.insert(self.slot, place, slots[fresh])
        piece = slots[back]
        n = self.bounds[piece + 1] - self.bounds[piece]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.bounds[piece], n) + np.arange(place[-1]) - np.repeat(place[:-1], n)]
        cut = place[np.searchsorted(starts, first)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): only longer documents are cut; the first piece takes what is over.

    A null or empty text is one piece of length 1, the end mark. Repeated rows and rows of a null id have pieces of their own.
    """

    def run(batches):
        encoder, part, count = encoder_of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            texts = batch.column(1).fill_null("")
            for low in range(0, len(texts), 512):
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")}
                for doc, ids in zip(ids_of[low : low + 512], encoder.encode(texts[low : low + 512].to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at, k, size = 0, 0, len(ids) % capacity or capacity
                    while at < len(ids):
                        for name, x in zip(rows, (doc, k, at, size, zlib.crc32(ids[at : at + size].tobytes()), part, int(count[size]))):
                            rows[name].append(x)
                        count[size] += 1
                        at, k, size = at + size, k + 1, capacity
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]))

    return docs.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def _reach(counts: np.ndarray, sizes: list[int], room: int) -> list[int]:
    """For each k the sums up to ``room`` that the first k of ``sizes``, as often as they are left, can make, as bits."""
    every = (1 << room + 1) - 1
    out = [1]
    for size in sizes:
        sums, left, step = out[-1], min(int(counts[size]), room // size), 1
        while left > 0 and sums != every:
            step = min(step, left)
            sums |= sums << step * size & every
            left, step = left - step, step * 2
        out.append(sums)
    return out


def _descend(sums: list[int], counts: np.ndarray, sizes: list[int], top: int, goal: int, times: list[int]) -> None:
    """Sets how often the first ``top`` sizes are taken to make ``goal``, which they can: the largest as often as possible."""
    for k in range(top - 1, -1, -1):
        n = min(int(counts[sizes[k]]), goal // sizes[k])
        while not sums[k] >> goal - n * sizes[k] & 1:
            n -= 1
        times[k] = n
        goal -= n * sizes[k]


def complete(counts: np.ndarray, room: int, largest: int) -> list[int]:
    """The filling of ``room`` by lengths with counts left that wastes least; of equals, the one with the largest lengths.

    It is exact: the sums that the lengths can make are bits of one number for each length, and the filling is
    read off them from the largest length down, without recursion.
    """
    sizes = np.flatnonzero(counts[: min(largest, room) + 1]).tolist()
    sums, times = _reach(counts, sizes, room), [0] * len(sizes)
    _descend(sums, counts, sizes, len(sizes), sums[-1].bit_length() - 1, times)
    return [size for size, n in zip(sizes[::-1], times[::-1]) for _ in range(n)]


def _following(counts: np.ndarray, room: int, largest: int, last: list[int] | None, most: int) -> list[int] | None:
    """The filling after ``last`` (the first, if None) by rising waste and, of equal wastes, falling lengths; None once over ``most``."""
    sizes = np.flatnonzero(counts[: min(largest, room) + 1]).tolist()
    sums, times = _reach(counts, sizes, room), [0] * len(sizes)
    goal = room
    if last is not None:
        place = {size: k for k, size in enumerate(sizes)}
        for size in last:
            times[place[size]] += 1
        goal, below = sum(last), 0
        for k, size in enumerate(sizes):
            for n in range(times[k] - 1, -1, -1):
                left = below + (times[k] - n) * size
                if sums[k] >> left & 1:
                    times[k] = n
                    _descend(sums, counts, sizes, k, left, times)
                    return [size for size, n in zip(sizes[::-1], times[::-1]) for _ in range(n)]
            below += times[k] * size
        goal -= 1
    while goal >= 0 and not sums[-1] >> goal & 1:
        goal -= 1
    if goal < 0 or room - goal > most:
        return None
    _descend(sums, counts, sizes, len(sizes), goal, times)
    return [size for size, n in zip(sizes[::-1], times[::-1]) for _ in range(n)]


def _dominated(counts: np.ndarray, room: int, largest: int, filling: list[int]) -> bool:
    """Whether a length left over could take the place of smaller ones, or of none, in the filling."""
    waste, own, sums = room - sum(filling), np.bincount(filling, minlength=len(counts)) if filling else np.zeros(len(counts), np.int64), 1
    for size in np.flatnonzero(counts[: min(largest, room) + 1]).tolist():
        low = max(size - waste, 0)
        if counts[size] > own[size] and sums >> low & (1 << size - low + 1) - 1:
            return True
        for _ in range(own[size]):
            sums |= sums << size
    return False


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, how many such sequences)] by best-fit decreasing; equal sequences are dealt with at once."""
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        open_rooms = [r for r in sorted(rooms) if r >= size]
        while left:
            room = open_rooms[0] if open_rooms else capacity
            own, n = rooms[room].pop() if open_rooms else ([], left)
            each = min(room // size, left)
            full = min(n, left // each)
            if open_rooms:
                if n > full:
                    rooms[room].append((own, n - full))
                if not rooms[room]:
                    del rooms[room], open_rooms[0]
            rooms.setdefault(room - each * size, []).append((own + [size] * each, full))
            left -= full * each
    return [x for group in rooms.values() for x in group]


def _least_waste(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """As ``_best_fit``, by the filling of least waste around the largest length left, each as often as its lengths last."""
    counts, out = counts.copy(), []
    for size in range(capacity, 0, -1):
        while counts[size]:
            counts[size] -= 1
            filling = [size, *complete(counts, capacity - size, size)]
            counts[size] += 1
            out.append((filling, _take(counts, filling)))
    return out


def _take(counts: np.ndarray, filling: list[int], most: int | None = None) -> int:
    """Takes the filling out of ``counts`` as often as possible (``most`` times at most); how often."""
    need = np.bincount(filling, minlength=len(counts))
    used = np.flatnonzero(need)
    times = int(min(counts[used] // need[used]))
    times = times if most is None else min(times, most)
    counts -= need * times
    return times


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: no two lengths over half share one, and those under a limit find only what these leave."""
    lengths = np.arange(capacity + 1)
    number, total, half = np.cumsum(counts), np.cumsum(counts * lengths), capacity // 2
    best = -(-int(total[-1]) // capacity)
    for least in range(1, half + 1):
        large = int(number[-1] - number[capacity - least])
        middle = int(number[capacity - least] - number[half])
        left = middle * capacity - int(total[capacity - least] - total[half])
        best = max(best, large + middle + max(0, -(-(int(total[half] - total[least - 1]) - left) // capacity)))
    return best


def _search(counts: np.ndarray, capacity: int, incumbent: list[tuple[list[int], int]], low: int) -> list[tuple[list[int], int]]:
    """The incumbent, or a packing of fewer sequences found by branch and bound; ends at ``low`` sequences or after ``WORK`` steps.

    A branch is a filling around the largest length left and how often it is used in a row, most first. What a state has
    left fixes all that it can become, so a state reached again with no less waste is not searched again.
    """
    best, total, work = sum(n for _, n in incumbent), int(counts @ np.arange(capacity + 1)), WORK
    seen: dict[bytes, int] = {}
    path: list[tuple[list[int], int]] = []
    levels: list[list] = [[counts.copy(), 0, None, 0]]  # what is left, waste so far, last filling, times still to try
    while levels and best > low and work > 0:
        left, waste, filling, times = levels[-1]
        del path[len(levels) - 1 :]
        size = int(np.flatnonzero(left)[-1])
        room = capacity - size
        allowed = (best - 1) * capacity - total - waste
        rest = left.copy()
        work -= int(np.count_nonzero(left)) + 1
        if not times:
            rest[size] -= 1
            filling = _following(rest, room, size, filling, allowed)
            while filling is not None and work > 0 and _dominated(rest, room, size, filling):
                work -= int(np.count_nonzero(left)) + 1
                filling = _following(rest, room, size, filling, allowed)
            rest[size] += 1
            spoilt = room - sum(filling) if filling is not None else 0
            if filling is None or spoilt > allowed:
                levels.pop()
                continue
            times = _take(rest, [size, *filling], allowed // spoilt if spoilt else None)
        else:
            spoilt = room - sum(filling)
            if spoilt * times > allowed:
                times = allowed // spoilt if allowed >= spoilt else 0
            if not times:
                levels[-1][3] = 0
                continue
            _take(rest, [size, *filling], times)
        levels[-1][2:] = filling, times - 1
        path.append(([size, *filling], times))
        if not rest.any():
            incumbent, best = list(path), sum(n for _, n in path)
            continue
        key = hashlib.blake2b(rest.tobytes(), digest_size=16).digest()
        if seen.get(key, 1 << 62) > waste + spoilt * times:
            seen[key] = waste + spoilt * times
            levels.append([rest, waste + spoilt * times, None, 0])
    return incumbent


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """[(length, rank from, rank to, first sequence, offset)] and the number of sequences."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    number, low = (lambda packing: sum(n for _, n in packing)), lower_bound(counts, capacity)
    chosen = min(_least_waste(counts, capacity), _best_fit(counts, capacity), key=number)
    if number(chosen) > low:
        chosen = _search(counts, capacity, chosen, low)
    taken, out, sequences = np.zeros(capacity + 1, np.int64), [], 0
    for filling, times in chosen:
        offset = 0
        for length in filling:
            out.append((length, int(taken[length]), int(taken[length]) + times, sequences, offset))
            taken[length] += times
            offset += length
        sequences += times
    return out, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null or empty text is the end mark alone. Repeated rows are packed as often as they come. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = keep(pieces(docs, tokenizer, capacity), "pieces")
    by_part = keep(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(histogram, capacity)
    table = np.array(sorted(segments), np.int64).reshape(-1, 5)
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    held = spark.sparkContext.broadcast(table)

    def place(batches):
        t = held.value
        key = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(t[at, 3] + rank - t[at, 1]), pa.array(t[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # The table of counts grows with the number of tasks, so it is never broadcast.
    return cut.join(before.hint("merge"), ["length", "part"]).mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
