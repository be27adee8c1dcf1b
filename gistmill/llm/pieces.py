"""SentencePiece encoding and decoding as shortest paths over a weighted finite-state transducer.

The model file is read without the library.  Three machines are compiled from it:

* the normaliser, a sequential transducer of three states (at the start, in a word, after spaces), whose arcs
  write the dummy space first and reduce runs of spaces (if the model asks for it) and write spaces as U+2581.  A character map is
  compiled into a trie whose longest match is read as one symbol, and what it writes is fed to those arcs;
* the lexicon, a trie of the pieces: its states are prefixes, and a state that is a piece has an arc back to the root that
  writes the piece's id.  Any character that is no piece has an arc of its own, which writes its bytes (byte fallback) or the
  unknown id, and weighs 10 more than the worst piece;
* the weights, in the tropical semiring (path weights add up, the least wins).  In a unigram
  model an arc weighs minus its score.  In a BPE model an arc weighs nothing, and the
  transition from piece a to piece b weighs nothing if encoding the string ab gives (a, b)
  and infinity otherwise.  A sequence of pieces is the BPE encoding of its string exactly
  if all its neighbours are compatible in this sense, so one path is finite and it is the encoding.
  Compatibility is read off the merge ranks along the seam of a and b; pieces of one score share a rank, and of equal ranks the leftmost is merged first.

Encoding composes the machines with a text and takes the shortest path, by relaxing the arcs of the composition: in
order of position, or, where finite weights are all zero, from the state reached last until the end is reached.  A state of it is a position and, in a BPE model, the last piece; of these one at most is finite at a position, so
a weight and a piece are held for each.  Arcs never cross the
seam of two characters that no piece holds side by side, so the composition falls apart there
and each part is solved once and, if short, remembered (at most twice ``remembered`` parts a worker).  Weights of unigram models
are added in 32 bits, as the library does, but part by part, which may tell only ties by rounding apart differently.

Decoding is the inverse: pieces spell characters, byte pieces UTF-8 (each invalid byte
becomes U+FFFD), U+2581 a space, and the dummy space is dropped.  What a character map has changed stays changed.

Models that define user pieces or unused BPE pieces, that don't escape spaces or that put the dummy space at the end are not taken; they
raise ValueError.

Defined cases.  Null and empty texts have no pieces.  Repeated rows give repeated results.
Texts are encoded whole, where they are read; nothing is shuffled.  Empty tables give empty
results.  Other columns are ignored, whatever their names.  U+2581 in a text is read as a space that is not reduced, as
the format has it, so such a text decodes to spaces.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.common import documents, id_and_text, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_INFINITE = 1 << 60
#: Characters of the longest part that is remembered.
_SHORT = 96
_ESCAPED = re.compile("[\udc80-\udcff]")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The rules (what is read, what is written) of a compiled character map: a double-array trie and the strings its leaves point to."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64), blob[4 + size :]
    labels, offsets = units & 0x800000FF, (units >> 10) << ((units & 512) >> 6)
    rules, every = {}, np.arange(1, 256)
    todo = [(int(offsets[0]), b"")]
    while todo:
        base, read = todo.pop()
        places = base ^ every
        inside = places < len(units)
        for byte in every[inside][labels[places[inside]] == every[inside]].tolist():
            at, key = base ^ byte, read + bytes((byte,))
            below = at ^ int(offsets[at])
            if units[at] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                rules[key.decode()] = strings[start : strings.index(b"\0", start)].decode()
            todo.append((below, key))
    return rules


class Normaliser:
    """Arcs: state -> symbol (a space, or None for any other) -> (what is written before the symbol, whether the symbol is written, next state)."""

    START, WORD, SPACES = range(3)

    def __init__(self, rules: dict[str, str], dummy: bool, reduce: bool):
        first = SPACE if dummy else ""
        word, space = (("", True, self.WORD), ("", False, self.SPACES)) if reduce else (("", True, self.WORD), (SPACE, False, self.WORD))
        self.arcs = {
            self.START: {None: (first, True, self.WORD), " ": ("", False, self.START) if reduce else (first + SPACE, False, self.WORD)},
            self.WORD: {None: word, " ": space},
            self.SPACES: {None: (SPACE, True, self.WORD), " ": ("", False, self.SPACES)},
        }
        #: The trie of the character map: (state, character) -> state, and what is written for a state that ends a rule.
        self.steps: dict[tuple[int, str], int] = {}
        self.written: dict[int, str] = {}
        made = 0
        for read, out in rules.items():
            state = 0
            for c in read:
                if (state, c) not in self.steps:
                    made += 1
                    self.steps[state, c] = made
                state = self.steps[state, c]
            self.written[state] = out
        #: In a word, all symbols but these go round one arc that writes them as they are.
        self.stops = {c for state, c in self.steps if state == 0}
        self.special = re.compile("[" + re.escape("".join(sorted(self.stops | {" "}))) + "]")
        #: With no rules and a space that stays in a word, so do spaces, written as U+2581.
        self.plain = not rules and space == (SPACE, False, self.WORD)

    def step(self, state: int, symbols: str, out: list[str]) -> int:
        """Read ``symbols``, which are spaces only or hold none of them."""
        for symbol in symbols if symbols[0] == " " else (symbols,):
            before, copied, state = self.arcs[state][" " if symbol[0] == " " else None]
            out += (before, symbol) if copied else (before,)
        return state

    def run(self, text: str) -> str:
        if self.plain:
            return self.arcs[self.START][None][0] + text.replace(" ", SPACE) if text else ""
        out: list[str] = []
        state, at = self.START, 0
        while at < len(text):
            hit = self.special.search(text, at)
            stop = hit.start() if hit else len(text)
            if stop > at:
                state, at = self.step(state, text[at:stop], out), stop
                continue
            node, end, found = 0, at, None
            while end < len(text) and (node := self.steps.get((node, text[end]))) is not None:
                end += 1
                if node in self.written:
                    found = (end, self.written[node])
            end, symbols = found or (at + 1, text[at])
            for part in re.findall(" +|[^ ]+", symbols):
                state = self.step(state, part, out)
            at = end
        done = "".join(out)
        return done.rstrip(SPACE) if self.arcs[self.WORD][" "][2] == self.SPACES else done


class Transducer:
    """The compiled model: ``normaliser``, the lexicon (``steps`` and ``ends``), and the weights of arcs and seams."""

    def __init__(self, model: bytes, remembered: int = 250_000):
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.controls: set[int] = set()
        self.unknown, self.kind = 0, UNIGRAM
        dummy = escape = reduce = True
        rules: dict[str, str] = {}
        unused = False
        byte_of: dict[int, int] = {}
        for number, value in _fields(model):
            if number == 1:
                entry = dict(_fields(value))
                piece, kind = entry[1].decode(), entry.get(3, _NORMAL)
                place = len(self.pieces)
                self.pieces.append(piece)
                if kind == _USER:
                    raise ValueError("models with user-defined pieces are not taken")
                if kind == _NORMAL:
                    self.ids[piece], self.score[piece] = place, struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0]
                elif kind == _BYTE:
                    self.bytes[int(piece[3:5], 16)] = place
                    byte_of[place] = int(piece[3:5], 16)
                elif kind == _UNKNOWN:
                    self.unknown = place
                elif kind == _CONTROL:
                    self.controls.add(place)
                unused |= kind == _UNUSED
            elif number == 2:
                spec = dict(_fields(value))
                self.kind = spec.get(3, UNIGRAM)
                if spec.get(24):
                    raise ValueError("models with the dummy space at the end are not taken")
            elif number == 3:
                spec = dict(_fields(value))
                rules = character_map(spec.get(2, b""))
                dummy, reduce, escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or not escape or (unused and self.kind == BPE):
            raise ValueError("only unigram and BPE models that escape spaces and have no unused BPE pieces are taken")
        self.normaliser, self.dummy = Normaliser(rules, dummy, reduce), dummy
        #: What each id spells; bytes over 127 as lone surrogates until a text is whole.
        self.spelling = ["" if i in self.controls else " ⁇ " if i == self.unknown else p for i, p in enumerate(self.pieces)]
        for i, byte in byte_of.items():
            self.spelling[i] = chr(byte if byte < 128 else 0xDC00 + byte)
        ranks = {score: i for i, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: ranks[s] if len(p) > 1 else -1 for p, s in self.score.items()}
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Whether U+2581 after another character always starts a part.
        self.parted = not any(j[1] == SPACE != j[0] for j in self.joined)
        self.unknown_weight = np.float32(10) - np.float32(min(self.score.values(), default=0.0))
        self.split: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        #: The lexicon: for each state, the character of each arc and the state it leads to; and the piece that ends there.
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for p in self.ids:
            if self.kind == BPE and len(p) > 1 and not self.last_merge(p):
                continue  # merging its characters does not give it: it is on no finite path
            state = 0
            for c in p:
                if c not in self.steps[state]:
                    self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(None)
                state = self.steps[state][c]
            self.ends[state] = p
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered

    # ------------------------------------------------------------ weights

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that ``piece`` is merged from; None for a character or a piece that merging its characters does not give."""
        if piece not in self.split:
            parts = list(piece)
            last = None
            while len(parts) > 1:
                best, at = _INFINITE, -1
                for i in range(len(parts) - 1):
                    rank = self.rank.get(parts[i] + parts[i + 1], _INFINITE)
                    if rank < best:
                        best, at = rank, i
                if at < 0:
                    last = None
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [last[0] + last[1]]
            self.split[piece] = last
        return self.split[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether no merge across the seam of a and b comes before the merges that made them."""
        limit = _INFINITE
        while self.rank.get(a + b, _INFINITE) >= limit or a + b not in self.rank:
            if self.rank.get(a, -1) > self.rank.get(b, -1):
                limit = self.rank[a]
                a = self.last_merge(a)[1]
            elif len(b) == 1:
                return True
            else:  # made by a merge to the right, before which an equal one across the seam comes
                limit = self.rank[b] + 1
                b = self.last_merge(b)[0]
        return False

    def seam(self, a: str, b: str) -> float:
        """The weight of the transition from piece a to piece b."""
        if self.kind == UNIGRAM:
            return 0.0
        fit = self.fits.get((a, b))
        if fit is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            fit = self.fits[a, b] = self.compatible(a, b)
        return 0.0 if fit else math.inf

    def weight(self, piece: str) -> float:
        """The weight of the arc that writes ``piece``, or a character that is none."""
        if self.kind == BPE:
            return 0.0
        return -np.float32(self.score[piece]) if piece in self.score else self.unknown_weight

    def arcs(self, part: str, i: int) -> list[str]:
        """What the arcs back to the root read from place i: pieces, shortest first, and the fallback of a character that is none."""
        out: list[str] = []
        steps, ends, state = self.steps, self.ends, 0
        for j in range(i, len(part)):
            state = steps[state].get(part[j])
            if state is None:
                break
            if ends[state] is not None:
                out.append(ends[state])
        return out if out and len(out[0]) == 1 else [part[i], *out]

    # ------------------------------------------------------------ shortest paths

    def path(self, part: str) -> list[str]:
        """What the arcs of the shortest path read of a part of normalised text."""
        n = len(part)
        weight: list[float] = [0.0] + [math.inf] * n
        last: list[str | None] = [None] * (n + 1)
        if self.kind == UNIGRAM:
            for i in range(n):
                for piece in self.arcs(part, i):
                    total = weight[i] + self.weight(piece)
                    if total < weight[i + len(piece)]:
                        weight[i + len(piece)], last[i + len(piece)] = total, piece
        else:
            # finite weights are all zero, so what is reached is settled: the last reached, by the longest arc, is relaxed first, up to the end
            arcs, fits, seam, open_at = self.arcs, self.fits, self.seam, [0]
            while weight[n]:
                i = open_at.pop()
                before = last[i]
                for piece in arcs(part, i):
                    j = i + len(piece)
                    if weight[j] and (before is None or fits.get((before, piece)) or not seam(before, piece)):
                        weight[j], last[j] = 0.0, piece
                        open_at.append(j)
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def spelled(self, piece: str) -> tuple[int, ...]:
        """The ids that an arc writes."""
        if piece in self.ids:
            return (self.ids[piece],)
        return tuple(self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")) if self.bytes else (self.unknown,)

    def solve(self, text: str) -> list[int]:
        return [x for p in self.path(text) for x in self.spelled(p)]

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of normalised text, cut wherever no piece holds the two characters."""
        joined = self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        if not cuts:
            return tuple(self.solve(text))
        out: list[int] = []
        known, older = self.known, self.older
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            # the first is remembered as the word that it is, others under a mark that no word starts with
            key = text[1:b] if not a and b > 1 and text[0] == SPACE else "\ud800" + text[a:b]
            got = known.get(key) or older.get(key)
            if got is None:
                got = tuple(self.solve(text[a:b]))
                if len(known) < self.remembered and b - a <= _SHORT:
                    known[key] = got
            out += got
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        text = self.normaliser.run(text)
        if not text:
            return []
        out: list[int] = []
        if not self.parted:
            out += self.part(text)
        else:
            words = text.split(SPACE)
            if words[0]:
                out += self.part(words[0])
            known, spaces = self.known, 0
            for word in words[1:]:
                if not word:
                    spaces += 1
                    continue
                # what follows U+2581: a word, after further U+2581 in a run
                key = SPACE * spaces + word if spaces else word
                spaces = 0
                got = known.get(key)
                if got is None:
                    got = self.older.get(key) or self.part(SPACE + key)
                    if len(key) <= _SHORT:
                        if len(known) >= self.remembered:  # the older half goes, what is in use comes back from it
                            self.older = known
                            known = self.known = {}
                        known[key] = got
                out += got
            if spaces:
                out += self.part(SPACE * spaces)
        if not self.bytes and self.unknown in out:
            out = [x for i, x in enumerate(out) if x != self.unknown or not i or out[i - 1] != x]
        return out

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.spelling.__getitem__, ids))
        if not text.isascii() and _ESCAPED.search(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")
            text = _ESCAPED.sub("\ufffd", text)
        text = text.replace(SPACE, " ")
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if self.dummy and first is not None and self.pieces[first].startswith(SPACE) else text


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    """Compiled once a worker process; its memory of parts is bounded."""
    return Transducer(model)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """gm_id, ids, n_tokens and exact: whether decoding the ids gives the text back."""
    small_batches(df.sparkSession)
    with open(model_path, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())
    rows = id_and_text(df, id_col, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [v.as_py() or "" for v in part.column(1)]
                ids = [machine.encode(t) for t in found]
                exact = [machine.decode(i) == t for i, t in zip(ids, found)]
                sizes = [len(i) for i in ids]
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=sum(sizes))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes, pa.int64()), pa.array(exact)], names=["gm_id", "ids", "n_tokens", "exact"])

    kind = rows.schema["gm_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"gm_id {kind}, ids array<int>, n_tokens long, exact boolean")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """gm_id and text of every row of ids."""
    with open(model_path, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())
    rows = df.select(F.col(f"`{id_col}`").alias("gm_id"), F.col(f"`{ids_col}`").alias("gm_ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(held.value)
        for batch in batches:
            found = [machine.decode(v or []) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["gm_id", "text"])

    return rows.mapInArrow(work, f"gm_id {rows.schema['gm_id'].dataType.simpleString()}, text string")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document as ids of the public 32k BPE model with byte fallback, and whether they decode to it."""
    return encode(documents(spark, sf_dir)).select(F.col("gm_id").alias("doc_id"), "ids", "n_tokens", "exact")
