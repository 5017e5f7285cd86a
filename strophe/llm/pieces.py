"""SentencePiece encoding by a table of last tokens, and decoding.

The merge order of a BPE model settles a text from its pairs alone: a sequence of pieces is the encoding if
each piece encodes to itself and each two neighbours, taken alone, encode to themselves.  So every prefix of a text
has one last token: an automaton gives all pieces that end at a place, and the one that the last token before it
goes with is written into the table; the ids are recovered from the end.  Time is linear in the text, and no
queue of merges is kept.

Whether two pieces go together is decided by their merges: those of the left piece move its last symbol, those of the right
one its first symbol, and the pair fails as soon as joining these two comes first.  Where no piece holds a
space mark after another character, merges never reach over the start of such a run, so a text is cut there (before punctuation
and at line breaks likewise, where no piece holds them inside); each distinct word of a run of texts is looked up once, and up to twice
``MOST_KNOWN`` words are remembered.

Texts are normalised by the library with the model's own rules.  Characters that no piece holds become bytes, or one unknown
id for each run where a model has no bytes.  Models of another kind than BPE, and those with user-defined or unused
pieces, raise.

Defined cases: null and empty texts have no ids and decode to the empty text; ids of rows play no part, so repeated rows and
null ids each come back; long runs without a space take the same linear way; an empty table gives an empty result; the
columns of a table pass, but for ``ids`` and ``decoded``, which are replaced.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MOST_KNOWN = 250_000
MOST_PAIRS = 400_000
LONGEST_KNOWN = 64
SLICE_BYTES = 16 << 20


class Pieces:
    """A model's pieces, its prefix tables and the ids they give."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.id_of = {}, {}
        for i in range(self.model.vocab_size()):
            if self.model.is_unused(i):
                raise ValueError("unused pieces are not supported")
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)):
                self.rank[self.model.id_to_piece(i)] = -self.model.get_score(i)
                self.id_of[self.model.id_to_piece(i)] = i
        byte = {self.model.id_to_piece(i): i for i in range(self.model.vocab_size()) if self.model.is_byte(i)}
        self.bytes = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
        self.merges: dict[str, list[tuple[float, str, str]]] = {}
        #: A piece, its length, its ids (-1 for a character without one), and which pieces were found to go after it.
        self.automaton = ahocorasick.Automaton()
        for piece in {*self.rank, *chain.from_iterable(self.rank)}:
            if self._merged(piece):
                self.automaton.add_word(piece, (piece, len(piece), self._ids(piece), {}))
        self.automaton.make_automaton()
        #: Whether no piece holds a space mark after another character; marks that none holds after anything but marks of these.
        self.cuts = not any(p[i - 1] != SPACE and p[i] == SPACE for p in self.rank for i in range(1, len(p)))
        breaks = "\n" if not any("\n" in p for p in self.rank) else ""
        before: dict[str, set[str]] = {c: set() for c in string.punctuation}
        for p in self.rank:
            for x, c in pairwise(p):
                if c in before:
                    before[c].add(x)
        marks = set(before)
        while odd := {c for c in marks if before[c] - marks - {SPACE}}:
            marks -= odd
        marks = re.escape("".join(sorted(marks)))
        rest = f"[^{SPACE}{marks}{breaks}]"
        kinds = [f"{SPACE}+[{marks}]*{rest}*", f"[{marks}]+{rest}*"] if marks else [f"{SPACE}+{rest}*"]
        self.split = re.compile("|".join([*kinds, f"{rest}+", *([f"{breaks}+"] if breaks else [])])).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.n_pairs = 0

    def _merged(self, piece: str) -> bool:
        """Whether a piece encodes to itself; its merges in order, each with the last and the first symbol after it."""
        symbols, steps = list(piece), []
        while len(symbols) > 1:
            best = min(((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))))  # noqa: B905
            if best[0] == float("inf"):
                return False
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            steps.append((best[0], symbols[-1], symbols[0]))
        self.merges[piece] = steps
        return True

    def _ids(self, piece: str) -> bytes:
        if piece in self.id_of:
            return np.int32(self.id_of[piece]).tobytes()
        return np.array([self.bytes[b] for b in piece.encode()] if self.bytes else [-1], dtype=np.int32).tobytes()

    def together(self, left: str, right: str) -> bool:
        """Whether two neighbours stay as they are; of equal ranks the merge further left comes first."""
        fits = self._together(left, right)
        self.n_pairs += 1
        if self.n_pairs > MOST_PAIRS:
            for _, _, _, after in self.automaton.values():
                after.clear()
            self.n_pairs = 1
        return fits

    def _together(self, left: str, right: str) -> bool:
        a, b = self.merges[left], self.merges[right]
        i = j = 0
        last, first = left[-1], right[0]
        never = float("inf")
        while True:
            joined = self.rank.get(last + first, never)
            own = a[i][0] if i < len(a) else never
            other = b[j][0] if j < len(b) else never
            if joined < own and joined <= other:
                return False
            if own == other == never:
                return True
            if own <= other:
                last = a[i][1]
                i += 1
            else:
                first = b[j][2]
                j += 1

    def table(self, text: str) -> list[tuple | None]:
        """The last token of each prefix; none where a character occurs in no piece."""
        last: list[tuple | None] = [None] * len(text)
        for end, piece in self.automaton.iter(text):
            if last[end] is None:
                start = end - piece[1]
                if start >= 0 and (before := last[start]) is not None:
                    fits = before[3].get(piece[0])
                    if fits is None:
                        fits = self.together(before[0], piece[0])
                        before[3][piece[0]] = fits
                    if not fits:
                        continue
                last[end] = piece
        return last

    def ids(self, text: str) -> bytes:
        """Ids of a text by its table, from the end, four bytes each; -1 stands for a character without one in a model without bytes."""
        last, at, out = self.table(text), len(text) - 1, []
        while at >= 0:
            piece = last[at]
            if piece is None:
                out.append(self._ids(text[at]))
                at -= 1
            else:
                out.append(piece[2])
                at -= piece[1]
        out.reverse()
        return b"".join(out)

    def word(self, word: str) -> bytes:
        """Ids of a space mark and what follows it, up to the next one."""
        found = self.older.get(word)
        if found is not None:
            self._keep(word, found)
        elif word.isalnum() or len(parts := self.split(SPACE + word)) == 1:
            found = self.ids(SPACE + word)
            self._keep(word, found)
        else:
            found = b"".join(map(self.part, parts))
        return found

    def part(self, part: str) -> bytes:
        """Ids of what stands between two cuts; those after one space mark are known as words."""
        key = part[1:] if part[0] == SPACE and part[1:2] != SPACE else SPACE + part
        found = self.known.get(key)
        if found is None:
            found = self.older.get(key)
            found = self.ids(part) if found is None else found
            self._keep(key, found)
        return found

    def _keep(self, text: str, ids: bytes) -> None:
        """Two generations: what the older one holds goes unless it is met again."""
        if len(text) > LONGEST_KNOWN:
            return
        if len(self.known) >= MOST_KNOWN:
            self.known, self.older = {}, self.known
        self.known[text] = ids

    def encoded(self, text: str) -> np.ndarray:
        text, out = self.model.normalize(text), []
        if not self.cuts:
            out.append(self.ids(text))
        elif text[:1] == SPACE and SPACE * 2 not in text:  # a space mark before each word
            known, add, word = self.known.get, out.append, self.word
            for w in text[1:].split(SPACE):
                found = known(w)
                if found is None:
                    found = word(w)
                    known = self.known.get
                add(found)
        else:
            out += map(self.part, self.split(text))
        ids = np.frombuffer(b"".join(out), dtype=np.int32)
        if self.bytes is None:  # a run of unknown characters is one token
            ids = ids[np.r_[True, (ids[1:] >= 0) | (ids[:-1] >= 0)]] if len(ids) else ids
            ids = np.where(ids < 0, self.model.unk_id(), ids)
        return ids

    def encode(self, text: str) -> list[int]:
        return self.encoded(text).tolist()

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """Ids of many texts.  Those with runs of space marks are cut one by one; of the others each distinct word is looked up once."""
        shaped = pa.array([self.model.normalize(t) for t in texts], pa.string())
        odd = pc.or_(pc.match_substring(shaped, SPACE * 2), pc.invert(pc.or_(pc.equal(shaped, ""), pc.starts_with(shaped, SPACE))))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool) if self.cuts and self.bytes else np.ones(len(texts), dtype=bool)
        if not odd.any():
            return self._of_words(shaped)
        rows = [self.encoded(texts[i]) for i in np.flatnonzero(odd)]
        own = _lists(np.concatenate([np.zeros(0, dtype=np.int32), *rows]), np.cumsum([0, *map(len, rows)]))
        place = np.argsort(np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)])
        return pa.concat_arrays([self._of_words(shaped.filter(pa.array(~odd))), own]).take(pa.array(place))

    def _of_words(self, shaped: pa.StringArray) -> pa.ListArray:
        """Ids of normalised texts that are words with a space mark before each."""
        words = pc.split_pattern(pc.if_else(pc.equal(shaped, ""), None, pc.utf8_slice_codeunits(shaped, 1)), SPACE)
        coded = words.flatten().dictionary_encode()
        known, found = self.known.get, []
        for w in coded.dictionary.to_pylist():
            ids = known(w)
            if ids is None:
                ids = self.word(w)
                known = self.known.get
            found.append(ids)
        each = _lists(np.frombuffer(b"".join(found), dtype=np.int32), np.cumsum([0, *map(len, found)]) // 4).take(coded.indices)
        n_words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        return _lists(each.values, each.offsets.to_numpy()[np.r_[0, np.cumsum(n_words)].astype(np.int64)])


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE_BYTES`` of memory in ``column``: long texts don't meet in one batch of results."""
    per_row = max(1, batch.column(column).nbytes // max(1, batch.num_rows))
    step = max(1, SLICE_BYTES // per_row)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _with(docs: DataFrame, added: dict[str, str], source: str, make) -> DataFrame:
    """``docs`` with more columns; ``make()`` gives a function of the values of ``source``: an Arrow array for each of them."""
    own = docs.drop(*added)
    schema = own.withColumns({name: F.lit(None).cast(kind) for name, kind in added.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for rows in _slices(batch, source):
                yield pa.RecordBatch.from_arrays([*rows.columns, *each(rows.column(source))], names=[*rows.schema.names, *added])

    return own.mapInArrow(run, schema)


def _texts(decode, ids: pa.ListArray) -> pa.Array:
    """Decoded texts, one list of ids at a time."""
    values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return pa.array([decode(values[i:k].tolist()) if k > i else "" for i, k in pairwise(ends.tolist())], pa.string())


def encoded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``: its texts encoded without begin and end ids."""

    def make():
        encode = pieces(model).encode_all
        return lambda texts: [encode([x or "" for x in texts.to_pylist()])]

    return _with(docs, {"ids": "array<int>"}, text, make)


def decoded(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the text of its ids by the library."""

    def make():
        import sentencepiece

        decode = sentencepiece.SentencePieceProcessor(model_file=model).decode
        return lambda values: [_texts(decode, values)]

    return _with(docs, {"decoded": "string"}, ids, make)


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, both made by one worker."""

    def make():
        own = pieces(model)

        def run(texts: pa.Array) -> list[pa.Array]:
            ids = own.encode_all([x or "" for x in texts.to_pylist()])
            return [ids, _texts(own.model.decode, ids)]

        return run

    return _with(docs, {"ids": "array<int>", "decoded": "string"}, text, make)
