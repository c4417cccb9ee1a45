"""SentencePiece encoding with seeded merge-dropout, and decoding that gives the text back.

A text is its characters, spaces written as the space mark and one mark put in front. Candidate
merges of neighbouring symbols wait in an agenda, best score first, leftmost first among equals.
When a candidate's turn comes, a keyed hash of (seed, draw, segment, place) decides whether it is
skipped, where every occurrence of a segment has a draw of its own, by text and place; with rate 0 the result is the model's own segmentation. Characters without a piece become
bytes. A space mark that stands in the text itself is written as bytes too, so decoding is exact.

No piece reaches across the end of a word, so a text falls into segments (spaces and the word after
them) that are encoded by themselves. What is remembered, up to ``REMEMBERED`` entries, is a segment's
agenda after given skips: its merges in order and the ids they lead to. An occurrence asks its own
hashes along the merges; the first skip leads to the next entry, and what is not remembered runs by
itself, as do a segment met for the first time and a skip met seldom. So the memory changes no result.

A missing text is empty and has no tokens. Equal (seed, key, text) give equal tokens on every run.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.llm import arrays
from tabeval.llm.common import leanly, text_of, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20_240_601
RATE = 0.1
REMEMBERED = 300_000
MARKED = 200_000  # skips met a few times, and segments met once
WORTH = 8  # occurrences of a skip that are worth an entry
LONGEST_REMEMBERED = 40  # characters
AT_A_TIME = 8_192  # segments that are encoded together

MARK = "▁"
_MASK = (1 << 64) - 1


def _bases(crc: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """What ``encode_segment`` calls base, for many segments."""
    base = crc << np.uint64(20) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK)
    return base ^ (draws + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)


def _crc(segment: str) -> int:
    return zlib.crc32(segment.encode("utf-8", "surrogatepass"))


def _skipped(base: np.ndarray, merge: np.ndarray, bound: np.uint64) -> np.ndarray:
    h = (base ^ merge) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32) < bound


class _Agendas:
    """Remembered agendas. An entry is a segment with the merges that are skipped; it holds the merges that
    follow the last skip, and the ids if none of them is skipped."""

    def __init__(self):
        self.first: dict[str, int] = {}  # of a segment, its entry without skips
        self.next: dict[int, int] = {}  # of entry and merge number, the entry that skips it too
        self.few: dict[int, int] = {}  # how often an entry and merge number were met, forgotten when they are many
        self.met: set[str] = set()  # segments met once, forgotten likewise
        self.ids: list[bytes] = []
        self.origin: list[tuple[str, tuple, int]] = []  # segment, skips, merges before the last skip
        self.crc, self.start, self.count = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.merges, self.used = np.zeros(4096, np.uint64), 0

    def _enter(self, segment: str, skips: tuple, before: int, ids: bytes, merges: list[int]) -> int:
        entry = len(self.ids)
        if entry == len(self.crc):
            self.crc, self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.crc, self.start, self.count))
        while self.used + len(merges) > len(self.merges):
            self.merges = np.concatenate([self.merges, np.zeros_like(self.merges)])
        self.merges[self.used : self.used + len(merges)] = merges
        self.crc[entry] = _crc(segment)
        self.start[entry], self.count[entry] = self.used, len(merges)
        self.used += len(merges)
        self.ids.append(ids)
        self.origin.append((segment, skips, before))
        return entry

    def _after(self, pieces: Pieces, entry: int, k: int, times: int) -> int:
        """The entry that skips merge k too; -1 until it was met often enough, as most are rare."""
        key = entry << 8 | k
        found = self.next.get(key)
        if found is None:
            times += self.few.pop(key, 0)
            if times < WORTH:
                if len(self.few) >= MARKED:
                    self.few.clear()
                self.few[key] = times
                return -1
            segment, skips, before = self.origin[entry]
            skips, trace = (*skips, int(self.merges[self.start[entry] + k])), []
            ids = np.array(pieces.encode_segment(segment, skips=skips, trace=trace), np.int32).tobytes()
            found = self.next[key] = self._enter(segment, skips, before + k, ids, trace[before + k :])
        return found

    def encode(self, pieces: Pieces, segments: list[str], draws: np.ndarray, seed: int, rate: float) -> list[bytes]:
        """``encode_segment`` for each segment with its draw."""
        first, met = self.first, self.met
        fresh = []
        for s, n in Counter(segments).items():
            if s not in first and len(s) <= LONGEST_REMEMBERED:
                if n > 1 or s in met:
                    met.discard(s)
                    fresh.append(s)
                else:
                    if len(met) >= MARKED:
                        met.clear()
                    met.add(s)
        traces: list[list[int]] = [[] for _ in fresh]
        for s, ids, trace in zip(fresh, pieces.encode_segments(fresh, np.zeros(len(fresh), np.uint64), seed, 0.0, traces), traces):
            first[s] = self._enter(s, (), 0, ids, trace)
        entry = np.fromiter(map(first.get, segments, repeat(-1)), np.int64, len(segments))
        bound = np.uint64(int(rate * (1 << 32)))
        live = np.flatnonzero(entry >= 0) if bound else np.zeros(0, np.int64)
        crc = self.crc[entry]
        for i in np.flatnonzero(entry < 0).tolist():
            crc[i] = _crc(segments[i])
        base = _bases(crc, draws, seed)
        while len(live):
            at = entry[live]
            count = self.count[at]
            ends = np.cumsum(count)
            of = np.repeat(np.arange(len(live)), count)
            k = np.arange(len(of)) - np.repeat(ends - count, count)
            hit = np.flatnonzero(_skipped(base[live][of], self.merges[self.start[at][of] + k], bound))
            some, first = np.unique(of[hit], return_index=True)
            # Many occurrences skip the same merge of the same entry.
            ways, back, times = np.unique(at[some] << 8 | k[hit[first]], return_inverse=True, return_counts=True)
            live = live[some]
            entry[live] = np.array([self._after(pieces, w >> 8, w & 255, n) for w, n in zip(ways.tolist(), times.tolist())], np.int64)[back]
            live = live[entry[live] >= 0]
        known = self.ids
        out = [known[e] if e >= 0 else b"" for e in entry.tolist()]
        alone = np.flatnonzero(entry < 0)
        if len(alone):
            places = alone.tolist()
            for i, ids in zip(places, pieces.encode_segments([segments[i] for i in places], draws[alone], seed, rate, base=base[alone])):
                out[i] = ids
        return out


@dataclass
class Pieces:
    """A model's pieces; small enough to travel with a task."""

    ranks: dict[str, int]  # of the score, best first; equal scores share one
    ids: dict[str, int]
    byte_ids: list[int]
    texts: list[bytes]  # by id, what it decodes to
    breaks: str
    memory: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, ids, byte_ids, texts = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                scores[piece], ids[piece] = model.get_score(i), i
                texts.append(piece.replace(MARK, " ").encode())
        if 0 in byte_ids:
            raise ValueError("the model has no byte pieces, so it cannot give every text back")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError("the model has pieces that reach across words")
        used = set("".join(ids))
        order = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        return Pieces({p: order[x] for p, x in scores.items()}, ids, byte_ids, texts, "".join(c for c in "\n\r\t\v\f" if c not in used))

    def __getstate__(self):
        return {**self.__dict__, "memory": {}}

    def segments(self, text: str) -> list[str]:
        found = self.memory.get("segments")
        if found is None:
            found = self.memory["segments"] = re.compile(f" *[^ {self.breaks}]+|[{self.breaks}]| +" if self.breaks else " *[^ ]+| +").findall
        return found(" " + text) if text else []

    def encode_segment(
        self, segment: str, seed: int = SEED, variant: int = 0, rate: float = 0.0, skips: tuple = (), trace: list | None = None,
    ) -> list[int]:
        """Ids of one segment; ``segment`` has plain spaces. ``skips`` are skipped in any case; ``trace``
        takes the merges, as place and length in one number."""
        symbols = [MARK if c == " " else "" if c == MARK else c for c in segment]
        n, rank = len(symbols), self.ranks.get
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bound = int(rate * (1 << 32))
        base = (_crc(segment) << 20 ^ seed * 0x9E3779B97F4A7C15 ^ (variant + 1) * 0xBF58476D1CE4E5B9) & _MASK
        # A candidate is one number: rank, place, length of the merged piece.
        agenda = []
        for i in range(n - 1):
            if symbols[i] and symbols[i + 1]:
                r = rank(symbols[i] + symbols[i + 1])
                if r is not None:
                    agenda.append(r << 80 | i << 40 | 2)
        heapq.heapify(agenda)
        while agenda:
            item = heapq.heappop(agenda)
            a, size = item >> 40 & 0xFFFFFFFFFF, item & 0xFFFFFFFFFF
            left, b = symbols[a], follow[a]
            if not left or b >= n or len(left) + len(symbols[b]) != size:
                continue
            if bound:
                h = ((base ^ (a << 32) ^ size) * 0x94D049BB133111EB) & _MASK
                h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
                if h >> 32 < bound:
                    continue
            if skips and a << 32 | size in skips:
                continue
            if trace is not None:
                trace.append(a << 32 | size)
            both = symbols[a] = left + symbols[b]
            symbols[b] = ""
            b = follow[a] = follow[b]
            if b < n:
                before[b] = a
                if symbols[b]:
                    r = rank(both + symbols[b])
                    if r is not None:
                        heapq.heappush(agenda, r << 80 | a << 40 | size + len(symbols[b]))
            b = before[a]
            if b >= 0 and symbols[b]:
                r = rank(symbols[b] + both)
                if r is not None:
                    heapq.heappush(agenda, r << 80 | b << 40 | size + len(symbols[b]))
        out, i = [], 0
        while i < n:
            known = self.ids.get(symbols[i])
            if known is not None:
                out.append(known)
            else:
                raw = symbols[i] or MARK  # an empty symbol at the head of a run is a mark of the text
                out.extend(self.byte_ids[x] for x in raw.encode("utf-8", "surrogatepass"))
            i = follow[i]
        return out

    def _merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
        """The merges as sorted pairs of piece numbers with rank and result, the pieces of one character, and the
        characters that only longer pieces have."""
        if "merges" not in self.memory:
            found = sorted(
                (self.ids[p[:i]] << 32 | self.ids[p[i:]], rank, self.ids[p])
                for p, rank in self.ranks.items()
                for i in range(1, len(p))
                if p[:i] in self.ids and p[i:] in self.ids
            )
            pair, rank, to = (np.array(x, np.int64) for x in zip(*found))
            single = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
            code, number = (np.array(x, np.int64) for x in zip(*single))
            self.memory["merges"] = pair, rank, to, code, number, "".join(set("".join(self.ids)) - set(self.ids))
        return self.memory["merges"]

    def _spelled(self, ids: bytes) -> bytes:
        """The ids with the bytes of the characters that have no piece, which stand as -2 - character."""
        out = []
        for x in np.frombuffer(ids, np.int32).tolist():
            if x >= 0:
                out.append(x)
            else:
                out.extend(self.byte_ids[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32).tobytes()

    def encode_segments(
        self, segments: list[str], variants: np.ndarray | list[int], seed: int, rate: float, traces: list[list] | None = None,
        base: np.ndarray | None = None,
    ) -> list[bytes]:
        """``encode_segment`` for many segments at once, as bytes of 32-bit ids: every round takes the
        next candidate of each segment's agenda. Segments with odd characters are encoded singly.
        ``traces`` has a list for each segment's merges; ``base`` is what follows from segments, variants and seed."""
        code, number, inner = self._merges()[3:]
        out: list[bytes | None] = [None] * len(segments)
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        plain = np.flatnonzero(length <= LONGEST_REMEMBERED)
        together = "".join(segments)
        strange = [c for c in MARK + inner if c in together]
        if strange:
            plain = np.array([i for i in plain.tolist() if not any(c in segments[i] for c in strange)], np.int64)
        plain = plain[np.argsort(length[plain], kind="stable")]
        variants = np.array(variants, np.uint64)
        for first in range(0, len(plain), AT_A_TIME):
            at_ = plain[first : first + AT_A_TIME]
            some = at_.tolist()
            chars = np.frombuffer("".join([segments[i] for i in some]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            chars[chars == 32] = ord(MARK)
            at = np.minimum(np.searchsorted(code, chars), len(code) - 1)
            ids = np.where(code[at] == chars, number[at], -2 - chars)
            size = length[at_]
            odd = np.flatnonzero(np.bincount(np.repeat(np.arange(len(some)), size), ids < 0, minlength=len(some)) > 0)
            merged = None if traces is None else []
            if not rate:
                bases = np.zeros(len(some), np.uint64)
            elif base is None:
                bases = _bases(np.array([_crc(segments[i]) for i in some], np.uint64), variants[at_], seed)
            else:
                bases = base[at_]
            found, ends = self._rounds(ids, size, bases, rate, merged)
            begin = 0
            for i, end in zip(some, ends.tolist()):
                out[i] = found[begin:end]
                begin = end
            for k in odd.tolist():
                out[some[k]] = self._spelled(out[some[k]])
            if merged:
                row, merge = (np.concatenate(x) for x in zip(*merged))
                by = np.argsort(row, kind="stable")
                merge, begin = merge[by].tolist(), 0
                for i, end in zip(some, np.cumsum(np.bincount(row, minlength=len(some))).tolist()):
                    traces[i].extend(merge[begin:end])
                    begin = end
        for i, o in enumerate(out):
            if o is None:
                out[i] = np.array(
                    self.encode_segment(segments[i], seed, int(variants[i]), rate, trace=None if traces is None else traces[i]), np.int32
                ).tobytes()
        return out

    def _rounds(self, ids: np.ndarray, size: np.ndarray, base: np.ndarray, rate: float, merged: list | None = None) -> tuple[bytes, np.ndarray]:
        """The ids of all segments in a row, and where in these bytes each ends."""
        pair, rank_of, result_of = self._merges()[:3]
        n, width = len(size), int(size.max()) + 1  # the last column stands for no neighbour
        none = np.int64(1 << 40)

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
            at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            return np.where(pair[at] == key, rank_of[at], none), result_of[at]

        row = np.repeat(np.arange(n), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        symbol = np.full((n, width), -1, np.int64)
        symbol[row, col] = ids
        follow = np.tile(np.arange(1, width + 1), (n, 1))
        follow[np.arange(n), size - 1] = width - 1
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        before[:, 0] = width - 1
        long = np.ones((n, width), np.int64)
        rank = np.full((n, width), none)
        result = np.zeros((n, width), np.int64)
        if width > 2:
            rank[:, :-2], result[:, :-2] = look(symbol[:, :-2], symbol[:, 1:-1])
        bound = np.uint64(int(rate * (1 << 32)))
        symbol_, follow_, before_, long_, rank_, result_ = (x.reshape(-1) for x in (symbol, follow, before, long, rank, result))
        live = np.arange(n)
        while len(live):
            now = rank[live]
            a = now.argmin(axis=1)
            open_ = now[np.arange(len(live)), a] < none
            live, a = live[open_], a[open_]
            start = live * width
            here = start + a
            there = start + follow_[here]
            both = long_[here] + long_[there]
            todo = live
            if bound:
                skipped = _skipped(base[live], a.astype(np.uint64) << np.uint64(32) | both.astype(np.uint64), bound)
                rank_[here[skipped]] = none
                keep = ~skipped
                todo, a, start, here, there, both = (x[keep] for x in (todo, a, start, here, there, both))
            if not len(todo):
                continue
            if merged is not None:
                merged.append((todo, a << 32 | both))
            after = start + follow_[there]
            symbol_[here], long_[here], follow_[here] = result_[here], both, follow_[there]
            symbol_[there], rank_[there] = -1, none
            before_[after] = a
            rank_[here], result_[here] = look(symbol_[here], symbol_[after])
            ahead = start + before_[here]
            rank_[ahead], result_[ahead] = look(symbol_[ahead], symbol_[here])
        kept = symbol[:, :-1] != -1
        return symbol[:, :-1][kept].astype(np.int32).tobytes(), np.cumsum(kept.sum(axis=1)) * 4

    def encode_texts(self, texts: list[str], keys: list[int], seed: int = SEED, rate: float = RATE) -> list[np.ndarray]:
        """Ids of whole texts. A text's key and the place of each segment are the segment's draw."""
        agendas = self.memory.get("agendas")
        if agendas is None or len(agendas.ids) > REMEMBERED:
            agendas = self.memory["agendas"] = _Agendas()
        split = [self.segments(t) for t in texts]
        size = np.array([len(x) for x in split], np.int64)
        ends = np.cumsum(size)
        segments = [s for x in split for s in x]
        place = np.arange(len(segments)) - np.repeat(ends - size, size)
        own = arrays.mixed(np.array([k & _MASK for k in keys], np.uint64), seed)
        draw = arrays.mixed(np.repeat(own, size) + place.astype(np.uint64), seed)
        parts = agendas.encode(self, segments, draw, seed, rate)
        return [np.frombuffer(b"".join(parts[e - n : e]), np.int32) for n, e in zip(size.tolist(), ends.tolist())]

    def encode(self, text: str, key: int = 0, seed: int = SEED, rate: float = RATE) -> np.ndarray:
        return self.encode_texts([text], [key], seed, rate)[0]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if "texts" not in self.memory:
            size = np.array([len(t) for t in self.texts])
            self.memory["texts"] = np.frombuffer(b"".join(self.texts), np.uint8), np.cumsum(size) - size, size
        data, start, size = self.memory["texts"]
        length = size[ids]
        total = int(length.sum())
        ends = np.cumsum(length)
        at = np.arange(total) - np.repeat(ends - length, length) + np.repeat(start[ids], length)
        return data[at].tobytes()[1:]

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass") if len(ids) else ""


def encode(
    df: DataFrame, ident: str = "doc_id", text: str = "text", model: str = MODEL, seed: int = SEED, rate: float = RATE,
    apart: bool = False,
) -> DataFrame:
    """Per row: id, ids, n_tokens, and whether decoding the ids gives the text back byte by byte.

    Skips are drawn by the row's id. With ``apart`` an id may come many times, as a document's pieces and their
    repeats in a mix: skips are drawn by id, text and number among the rows equal in both, so that repeats
    differ and a rerun gives the same rows.
    """
    pieces = Pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key").to_pylist()
            for first in range(0, batch.num_rows, 256):
                some = texts.slice(first, 256).to_pylist()
                found = pieces.encode_texts(some, keys[first : first + 256], seed, rate)
                good = [(pieces.decode_bytes(f) if len(f) else b"") == t.encode("utf-8", "surrogatepass") for f, t in zip(found, some)]
                size = np.array([len(f) for f in found], np.int32)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, 256), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found))),
                        pa.array(size), pa.array(good),
                    ],
                    names=["id", "ids", "n_tokens", "lossless"],
                )

    if apart:
        rows = df.select(F.col(ident).alias("id"), text_of(text).alias("text")).withColumn("_text", F.md5(F.col("text").cast("binary")))
        equal = Window.partitionBy("id", "_text").orderBy("_text")
        key = F.xxhash64("id", "_text", F.row_number().over(equal))
        # Written, so that the sort and the encoder do not need their memory at the same time.
        rows = written(rows.select("id", key.alias("key"), "text"), "keyed")
    else:
        rows = df.select(F.col(ident).alias("id"), F.xxhash64(F.col(ident)).alias("key"), text_of(text).alias("text"))
    kind = df.schema[ident].dataType.simpleString()
    return rows.mapInArrow(leanly(run), f"id {kind}, ids array<int>, n_tokens int, lossless boolean")


def decode(df: DataFrame, ident: str = "id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Per row: id and the text of its ids; missing ids give an empty text."""
    pieces = Pieces.load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(F.col(ident).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind}, text string")
