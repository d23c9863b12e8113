"""SentencePiece encoding and decoding by suffix-array matching, and relaxation of the sorted matches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.shared import release_memory

SPACE = "▁"
#: Characters of texts whose words are indexed together; places of the table of pairs of pieces; characters of a part
#: that are relaxed side by side with other parts.
BATCH_CHARS, PAIRS_HELD, DEEP = 500_000, 1 << 21, 48
NEVER = 1 << 60
#: Ends of a path that no piece reaches, and those where anything may follow.
NOWHERE, FRESH = -1, -2
#: What stands between words: a number above all characters.
BETWEEN = 0x110000


def fields(message: bytes) -> dict[int, int | bytes]:
    """Numbers and bytes of a protocol buffer message by field, the last of each."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            out[key >> 3] = message[at : at + size]
            at += size
    return out


def check_kind(message: bytes) -> None:
    """An error unless a model is BPE and leaves texts as they are but for blanks and the one that it puts first."""
    spec = fields(message)
    trainer, normal = fields(spec.get(2, b"")), fields(spec.get(3, b""))
    if trainer.get(3, 1) != 2:
        raise ValueError("the model must be BPE")
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model must put a blank first and change nothing else")


class Pieces:
    """A BPE model of SentencePiece with byte fallback: its pieces, and which pieces may stand side by side.

    A sequence of pieces is what the model's merges make if and only if each two neighbours are what the merges make of
    the two alone; so of all matches that end at a place only one can be last, and relaxing them in order finds it.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_kind(model.serialized_model_proto())
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.piece, special, strict=True)) if not s}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if model.is_byte(i)}
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        known = {c for p in self.ids for c in p}
        if len(self.byte) != 256 or inner or not known <= self.ids.keys():
            raise ValueError("the model must have byte fallback, a piece for each character of a piece, and no pieces across spaces")
        # rank: order of merges; pieces of blanks only share the last one and are made afterwards
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-model.get_score(self.ids[p]), self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order) if p.strip(SPACE)}
        self.blanks = {len(p) for p in self.ids if not p.strip(SPACE)}
        self.left: dict[int, list[tuple[str, int]]] = {}
        self.right: dict[int, list[tuple[str, int]]] = {}
        usable = []
        for p, i in self.ids.items():
            tree = self.merge(p)
            if len(tree) == 1:
                usable.append(i)
                self.right[i], self.left[i] = self.edge(tree[0], -1), self.edge(tree[0], 0)
        usable = [i for i in usable if self.piece[i].strip(SPACE) or len(self.piece[i]) == 1]
        self.match_ids = np.array(sorted(usable, key=lambda i: self.piece[i]), np.int64)
        self.lengths = np.array([len(self.piece[i]) for i in self.match_ids], np.int64)
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(usable), self.longest), np.int64)
        for r, i in enumerate(self.match_ids):
            self.codes[r, : self.lengths[r]] = np.frombuffer(self.piece[i].encode("utf-32-le"), np.uint32)
        self.pair_key, self.pair_fits = np.full(PAIRS_HELD, -1, np.int64), np.zeros(PAIRS_HELD, bool)
        self.single = np.array(sorted(map(ord, known)), np.int64)
        self.adjacent = np.array(sorted({ord(x) << 21 | ord(y) for p in self.ids for x, y in zip(p, p[1:], strict=False)}), np.int64)
        odd = "" if "\n" in known else "\n"  # a character that is no piece is a segment of its own
        self.segment = re.compile(f"{SPACE}*[^{SPACE}{odd}]+|{SPACE}+" + (f"|{odd}" if odd else ""))

    def merge(self, text: str) -> list:
        """What the merges make of a text: (piece, merged from) trees."""
        parts: list = [(c, ()) for c in text]
        while len(parts) > 1:
            ranks = [self.rank.get(a[0] + b[0], NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NEVER:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], (parts[k], parts[k + 1]))]
        return parts

    def edge(self, tree: tuple, side: int) -> list[tuple[str, int]]:
        """Pieces that stand at one end of a piece while it grows, each with the rank of the merge that takes it."""
        out, taken = [], NEVER
        while True:
            out.append((tree[0], taken))
            if not tree[1]:
                return out
            taken = self.rank[tree[0]]
            tree = tree[1][side]

    def fit(self, a: int, b: int) -> bool:
        """Whether the merges leave piece b after piece a as they are."""
        rank = self.rank.get
        for x, taken_x in self.right[a]:
            for y, taken_y in self.left[b]:
                m = rank(x + y, NEVER)
                if m < taken_x and m <= taken_y and m < NEVER:
                    return False
        return True

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`fit` of many pairs; a table of fixed size keeps the last ones."""
        key = a << 32 | b
        place = (key * -7046029254386353131 >> 40) & (PAIRS_HELD - 1)
        ok = self.pair_fits[place]
        unknown = np.flatnonzero(self.pair_key[place] != key)
        if len(unknown):
            new, first, at = np.unique(key[unknown], return_index=True, return_inverse=True)
            found = np.array([self.fit(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            ok[unknown] = found[at]
            where = place[unknown][first]
            self.pair_key[where], self.pair_fits[where] = new, found
            clash = self.pair_key[where] != new  # two new pairs at one place: the place keeps one of them, with its own answer
            self.pair_key[where[clash]] = -1
        return ok

    def blank_run(self, n: int) -> list[int]:
        """Ids of n blanks that no word takes: the leftmost two that make a piece merge, until none do."""
        parts: list[int] = []
        for _ in range(n):
            parts.append(1)
            while len(parts) > 1 and parts[-2] + parts[-1] in self.blanks:
                parts[-2:] = [parts[-2] + parts[-1]]
        return [self.ids[SPACE * x] for x in parts]

    # the suffix array and what it finds

    def suffixes(self, digits: np.ndarray, bits: int, taken: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys): places of a text in order of the next ``longest`` characters, and the numbers that the first
        ``taken`` characters of each make; after those by doubling."""
        key = digits
        for step in range(1, taken):
            after = np.zeros(len(digits), np.int64)
            after[:-step] = digits[step:]
            key = key << bits | after
        rank, step = key, taken
        while True:
            order = np.argsort(rank)
            if step >= self.longest:
                return order, key[order]
            ordered = rank[order]
            rank = np.empty(len(digits), np.int64)
            rank[order] = np.concatenate(([1], 1 + np.cumsum(ordered[1:] != ordered[:-1])))
            after = np.zeros(len(digits), np.int64)
            after[:-step] = rank[step:]
            rank = rank * (len(digits) + 2) + after
            step *= 2

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every match of every piece: binary searches for as many characters as a number holds,
        then a character at a time."""
        alphabet = np.unique(text)
        bits = len(alphabet).bit_length()
        taken = min(62 // bits, self.longest)
        array, key = self.suffixes(np.searchsorted(alphabet, text).astype(np.int64) + 1, bits, taken)
        inside = np.arange(self.longest) < self.lengths[:, None]
        some = np.flatnonzero((held(alphabet, self.codes) | ~inside).all(axis=1))
        lengths, codes = self.lengths[some], self.codes[some]
        digit = (np.searchsorted(alphabet, codes) + 1) * inside[some]
        low = np.zeros(len(some), np.int64)
        for d in range(taken):
            low = low << bits | digit[:, d]
        width = np.left_shift(1, bits * np.maximum(taken - lengths, 0))
        low, high = np.searchsorted(key, low), np.searchsorted(key, low + width)
        padded = np.concatenate((text, np.zeros(self.longest, np.int64)))
        for depth in range(taken, self.longest):
            live = np.flatnonzero((lengths > depth) & (low < high))
            if not len(live):
                break
            want = codes[live, depth]
            bounds = []
            for strict in (False, True):
                a, b = low[live].copy(), high[live].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    got = padded[array[np.minimum(mid, len(array) - 1)] + depth]
                    less = (got <= want) if strict else (got < want)
                    a = np.where(open_ & less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                bounds.append(a)
            low[live], high[live] = bounds
        found = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(found)), found)
        at = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + low[which]
        return array[at], lengths[which], self.match_ids[some][which]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words with at most one leading blank: index their concatenation, match, sort, relax.

        A part runs up to a character that no piece has after the one before it, so that no merge crosses. Relaxation goes
        through all parts side by side, one character at a time; what is left of long parts goes through alone.
        """
        joined = "\0" + "\0".join(words) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        between = np.cumsum([0, *(len(w) + 1 for w in words)])
        text[between] = BETWEEN
        n = len(text)
        begin, length, piece = self.occurrences(text)
        stop = begin + length
        lone = ~held(self.single, text)
        cut = np.ones(n + 1, bool)
        cut[1:-1] = ~held(self.adjacent, text[:-1] << 21 | text[1:])
        starts = np.flatnonzero(cut[:-1])
        offset = np.arange(n) - starts[np.cumsum(cut[:-1]) - 1]
        last, back = np.full(n + 1, NOWHERE), np.zeros(n + 1, np.int64)
        last[starts] = FRESH
        live = ~cut  # a part's end is the next one's start, where anything may follow: its last piece is kept apart
        final, final_back = np.full(n + 1, NOWHERE), np.zeros(n + 1, np.int64)
        place = np.minimum(offset[begin], DEEP).astype(np.uint8)  # edges by place in their part
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(DEEP + 1))
        for k in range(DEEP):
            edges = order[bounds[k] : bounds[k + 1]]
            if not len(edges):
                break
            before = last[begin[edges]]
            some = before != NOWHERE
            edges, before = edges[some], before[some]
            ok = before == FRESH
            ask = np.flatnonzero(~ok)
            ok[ask] = self.fits(before[ask], piece[edges[ask]])
            edges = edges[ok]
            inside = live[stop[edges]]
            x, y = edges[inside], edges[~inside]
            last[stop[x]], back[stop[x]] = piece[x], begin[x]
            final[stop[y]], final_back[stop[y]] = piece[y], begin[y]
        deep = order[bounds[DEEP] :]
        for e in deep[np.argsort(begin[deep])].tolist():
            a, b, p = int(begin[e]), int(stop[e]), int(piece[e])
            before = int(last[a])
            if before != NOWHERE and (before == FRESH or self.fits(np.array([before]), np.array([p]))[0]):
                if live[b]:
                    last[b], back[b] = p, a
                else:
                    final[b], final_back[b] = p, a
        chosen = np.full(n, NOWHERE)  # the piece of the way that starts at a place
        ends = np.flatnonzero(final != NOWHERE)
        at, p = final_back[ends], final[ends]
        while len(at):
            chosen[at] = p
            more = at[last[at] != FRESH]
            at, p = back[more], last[more]
        return self.flat(text, chosen, lone, between[1:])

    def flat(self, text: np.ndarray, chosen: np.ndarray, lone: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces by place, and bytes for characters that are no piece, as ids in a row, and where each word's end."""
        lone = np.flatnonzero(lone & (text != BETWEEN))
        size = (chosen != NOWHERE).astype(np.int64)
        size[lone] = 1 + (text[lone] > 0x7F) + (text[lone] > 0x7FF) + (text[lone] > 0xFFFF)
        if len(lone) and ((text[lone] >= 0xD800) & (text[lone] < 0xE000)).any():
            raise ValueError("a text holds half a surrogate pair")
        upto = np.cumsum(size)
        ids = np.zeros(int(upto[-1]), np.int64)
        some = np.flatnonzero(chosen != NOWHERE)
        ids[upto[some] - 1] = chosen[some]
        table = np.array([self.byte[b] for b in range(256)])
        if len(lone):
            code = np.frombuffer(text[lone].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            place = np.repeat(upto[lone] - size[lone], size[lone]) + np.arange(len(code)) - np.repeat(np.cumsum(size[lone]) - size[lone], size[lone])
            ids[place] = table[code]
        return ids, upto[ends]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts: their distinct words are indexed together, and each word's ids put where it stands."""
        cut = [self.segment.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        every = list(chain.from_iterable(cut))
        if not every:
            return [np.zeros(0, "<u4") for _ in texts]
        number = dict(zip(dict.fromkeys(every), count(), strict=False))
        which = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        words = list(number)
        runs: dict[int, int] = {}  # of blanks in a row the word may take the last
        for i in [i for i, w in enumerate(words) if w[:2] == SPACE * 2 or w == SPACE]:
            rest = words[i].lstrip(SPACE)
            runs[i] = len(words[i]) - len(rest)
            words[i] = SPACE + rest if rest else ""
        ids, ends = self.encode_words(words)
        starts = np.concatenate(([0], ends[:-1]))
        if runs:
            ids, starts, ends = self.with_blanks(ids, starts, ends, runs)
        size = (ends - starts)[which]
        upto = np.cumsum(size)
        flat = ids[np.repeat(starts[which] - (upto - size), size) + np.arange(int(upto[-1]))].astype("<u4")
        bounds = np.concatenate(([0], upto))[np.cumsum([0, *map(len, cut)])].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def with_blanks(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that stand after blanks in a row anew, behind all others, with the blanks before them."""
        extra, starts, ends, blank = [ids], starts.copy(), ends.copy(), self.ids[SPACE]
        end = len(ids)
        for i, n in runs.items():
            own = ids[starts[i] : ends[i]]
            if len(own) and own[0] == blank:
                own = own[1:]
            elif len(own):
                n -= 1
            extra += [np.array(self.blank_run(n), np.int64), own]
            starts[i], end = end, end + len(extra[-2]) + len(own)
            ends[i] = end
        return np.concatenate(extra), starts, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the blank that encoding puts first; bytes that are no text become U+FFFD."""
        table = self.bytes
        out = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out.removeprefix(" ")


def held(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, ids, n_ids, ids_crc32, same): each row of ``docs`` as a struct without its text, with the ids of its text.

    ``same`` says whether decoding the ids gives the text again. Within a task the words of many texts are indexed
    together, each distinct word once, for the model has no piece across spaces; so results are the library's, and no
    task holds more than a bounded batch. A null or empty text has no ids (``same`` is true). Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # what earlier steps in this worker have freed
        pieces = model(path)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(upto, upto[start] + BATCH_CHARS, side="right")) - 1)
                part, rows = texts.slice(start, end - start).to_pylist(), batch.column("row").slice(start, end - start)
                ids = pieces.encode(part)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                same = [pieces.decode(x) == (t or "") for x, t in zip(ids, part, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                    names=["row", "ids", "n_ids", "ids_crc32", "same"],
                )
                start = end
        release_memory()

    rest = F.struct(*[F.col(c) for c in docs.columns if c != text], F.lit(0).alias("_"))
    rows = docs.select(rest.alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>, n_ids long, ids_crc32 long, same boolean")
