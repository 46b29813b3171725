"""SentencePiece BPE over whole texts, encoded and decoded by vectorised merge rounds."""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_or_empty

SPACE = "▁"
#: Characters of texts that are cut into words at once, and of new words that are merged at once.
SLICE, MERGED = 1 << 20, 1 << 22
#: Words that a worker remembers between texts.
REMEMBERED = 1 << 18
#: Rounds that merge all words at once; what is left then is longer than this.
ROUNDS = 48
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NEVER = np.int32(2**31 - 1)
#: Code points end here; two of them make a key of 42 bits.
POINTS = 0x110000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _one_for_each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("lodestrata-byte", _one_for_each_byte)


class PieceModel:
    """A BPE model with byte fallback, identity normalisation and a space put before the text.

    A symbol is a piece, or a character that is no piece (its number starts at ``n_pieces``). ``pairs`` holds every way
    in which two symbols make a piece, as sorted keys with the rank and the number of that piece: the smaller the rank,
    the earlier it merges. Two neighbouring characters that stand side by side in no piece can never be merged across,
    so a text falls into words there (before each space that follows something else, around digits and so on).

    Merging all places of a word's best pair at once is what merging them from the left one by one gives, unless the
    new piece is part of a piece of better rank; for such pieces (``alone``) only the leftmost place is merged in a round.

    Models of other kinds (unigram, user-defined pieces, other normalisers, no byte fallback) are a ``ValueError``.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        kinds = np.array([p.type for p in model.pieces])
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not spec.treat_whitespace_as_suffix
        if spec.model_type != 2 or not plain or (kinds == BYTE).sum() != 256 or np.isin(kinds, (USER_DEFINED, UNUSED)).any():
            raise ValueError(f"{path} is no BPE model with byte fallback and identity normalisation")
        self.n_pieces = len(model.pieces)
        names = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        score = np.array([p.score for p in model.pieces])
        # equal scores merge from the left alike, so they share a rank
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)

        points = sorted({c for name in names for c in name})
        self.symbol = np.full(POINTS, -1, np.int32)
        for c in points:
            self.symbol[ord(c)] = names.get(c, self.n_pieces + ord(c))
        number = names | {c: int(self.symbol[ord(c)]) for c in points}
        keys, made, alone = [], [], np.zeros(self.n_pieces, bool)
        side_by_side = set()
        for name, i in names.items():
            side_by_side.update(zip(name, name[1:]))
            for cut in range(1, len(name)):
                left, right = number.get(name[:cut]), number.get(name[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(i)
                for part in (left, right):
                    if part is not None and part < self.n_pieces and rank[i] <= rank[part]:
                        alone[part] = True
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.ranks, self.alone = rank[self.made], alone
        self.beside = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in side_by_side], np.int64))
        self.by_byte = np.zeros(256, np.int32)
        written = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.by_byte[int(p.piece[1:-1], 16)] = i
            written.append(bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.controls, self.bytes_from = kinds == CONTROL, kinds == BYTE
        self.led = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.sizes = np.array([len(w) for w in written], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        self.begin, self.end = np.array([spec.bos_id], np.int32), np.array([spec.eos_id], np.int32)
        self._forget()

    # -- encoding -----------------------------------------------------------------------------------------------------

    def merged(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word ends.

        Rounds over flat arrays of symbols: the smallest rank of a pair in each word, all its places from the left that
        don't overlap, one compaction; words without a pair left drop out. A round merges once at least in each part, so
        only parts of more than ``ROUNDS`` symbols can outlast the rounds (long runs of one character, text without
        spaces); a round less would save them little, so they are ended one by one.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.symbol[points]
        symbols = np.where(symbols < 0, points + self.n_pieces, symbols)
        # a word may hold characters that no piece has side by side; it goes on as parts of its own
        part = np.zeros(len(points), np.int64)
        if len(points):
            apart = (word[1:] != word[:-1]) | ~self._found(self.beside, points[:-1] << 21 | points[1:])[0]
            part[1:] = np.cumsum(apart)
        done_symbols, done_at = [], []
        at = np.arange(len(points))  # where a symbol began; kept as the order of what is done
        rank, made = self._ranked(symbols, part, np.arange(len(points) - 1))
        for nth_round in range(ROUNDS + 1):
            if not len(symbols):
                break
            edges = np.flatnonzero(part[1:] != part[:-1]) + 1
            if nth_round == ROUNDS:
                for mine in np.split(np.arange(len(part)), edges):
                    ended = np.array(self._finished(symbols[mine].tolist()), np.int64)
                    done_symbols.append(ended[ended >= 0])
                    done_at.append(at[mine][ended >= 0])
                break
            heads = np.r_[0, edges]
            best = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.r_[heads, len(part)])
            ended = np.repeat(best == NEVER, sizes)
            if ended.any():
                done_symbols.append(symbols[ended])
                done_at.append(at[ended])
                symbols, part, at, rank, made = (x[~ended] for x in (symbols, part, at, rank, made))
                sizes, best = sizes[best != NEVER], best[best != NEVER]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            # of places in a row every other one counts, and of pieces that go alone the first in its part
            firsts = np.r_[True, part[hits[1:]] != part[hits[:-1]]]
            first = np.flatnonzero(firsts | np.r_[True, hits[1:] != hits[:-1] + 1])
            nth = np.arange(len(hits)) - np.repeat(first, np.diff(np.r_[first, len(hits)]))
            hits = hits[(nth % 2 == 0) & (firsts | ~self.alone[made[hits]])]
            symbols[hits] = made[hits]
            keep, changed = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
            keep[hits + 1] = False
            changed[hits] = True
            symbols, part, at, rank, made, changed = (x[keep] for x in (symbols, part, at, rank, made, changed))
            rank[changed] = NEVER
            changed[:-1] |= changed[1:]
            self._ranked(symbols, part, np.flatnonzero(changed[:-1]), rank, made)
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        symbols, at = np.concatenate(done_symbols), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return self._with_bytes(symbols[order], word[at[order]], len(words))

    def _found(self, among: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return among[at] == keys, at

    def _ranked(self, symbols: np.ndarray, part: np.ndarray, where: np.ndarray, rank: np.ndarray | None = None, made: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and number of the piece that the symbols at ``where`` make with the next one of their part."""
        if rank is None:
            rank, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
        rank[where] = NEVER
        inner = where[part[where + 1] == part[where]]
        there, at = self._found(self.keys, symbols[inner].astype(np.int64) << 32 | symbols[inner + 1])
        inner, at = inner[there], at[there]
        rank[inner], made[inner] = self.ranks[at], self.made[at]
        return rank, made

    def _with_bytes(self, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.n_pieces)
        if len(odd):
            kinds, which = np.unique(symbols[odd], return_inverse=True)
            spelt = [chr(int(s) - self.n_pieces).encode("utf-8", "surrogatepass") for s in kinds]
            sizes = np.ones(len(symbols), np.int64)
            sizes[odd] = np.array([len(x) for x in spelt])[which]
            starts = np.cumsum(sizes) - sizes
            ids = np.repeat(symbols, sizes)
            wide = np.zeros((len(kinds), 4), np.int32)
            for k, x in enumerate(spelt):
                wide[k, : len(x)] = self.by_byte[list(x)]
            for k in range(4):
                has = sizes[odd] > k
                ids[starts[odd[has]] + k] = wide[which[has], k]
            symbols, word = ids, np.repeat(word, sizes)
        return symbols.astype(np.int32), np.cumsum(np.bincount(word, minlength=n_words))

    def _finished(self, symbols: list[int]) -> list[int]:
        """What is left of one part after all its merges, taken one by one from a heap: the end of parts that rounds don't end."""
        n = len(symbols)
        before, after, gone = list(range(-1, n - 1)), [*range(1, n), -1], -1
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.table.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (found[0], i, found[1], symbols[i], symbols[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = made, gone, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return symbols

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with those of its begin and end; an empty text has these two alone.

        New words of some ``MERGED`` characters of texts are merged together.
        """
        waiting: list[list[str]] = []  # of whole texts
        parts: list[np.ndarray] = []  # of a text under way
        size = 0
        for text in texts:
            mine: list[str] = []
            for words, n in self._words(text):
                mine += words
                size += n
                if size > MERGED:
                    *whole, part = self._looked_up([*waiting, mine])
                    yield from map(self._framed, whole)
                    waiting, mine, size = [], [], 0
                    parts.append(part)
            if parts:
                (rest,) = self._looked_up([mine])
                yield self._framed(np.concatenate([*parts, rest]))
                parts, size = [], 0
            else:
                waiting.append(mine)
        if waiting:
            yield from map(self._framed, self._looked_up(waiting))

    def _framed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.begin, ids, self.end])

    def _looked_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or len(self.flat) > MERGED:
            self._forget()
        words = [w for t in texts for w in t]
        new = list(set(words).difference(self.known))
        if new:
            ids, ends = self.merged(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ends = np.concatenate([self.ends, len(self.flat) + ends])
            self.flat = np.concatenate([self.flat, ids])
        slot = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts = self.ends[slot]
        sizes = self.ends[slot + 1] - starts
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]
        cuts = np.r_[0, ends][np.cumsum([len(t) for t in texts], dtype=np.int64)]
        return np.split(ids, cuts[:-1])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _words(self, text: str) -> Iterator[tuple[list[str], int]]:
        """The words of a text with its spaces written as ``SPACE``, in lists of some ``SLICE`` characters."""
        if not text:
            return
        text = SPACE + text.replace(" ", SPACE)
        cut = re.compile(f"[^{SPACE}](?={SPACE})")
        start = 0
        while start < len(text):
            found = cut.search(text, start + SLICE)
            end = found.end() if found else len(text)
            yield re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text[start:end]), end - start
            start = end

    # -- decoding -----------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8.

        Begin and end have no text, the space before the text goes, pieces of bytes become the characters that they
        spell, and each byte that spells none U+FFFD.
        """
        shown = ~self.controls[ids]
        single = self.bytes_from[ids]
        # a run of bytes also ends at an id without text
        run = np.cumsum(~single | np.r_[True, ~single[:-1]])[shown]
        ids, single = ids[shown], single[shown]
        sizes = self.sizes[ids]
        if not sizes.sum():
            return b""
        ends = np.cumsum(sizes)
        gather = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        raw = self.written[gather].tobytes()
        if single.any() and not raw.isascii():
            heads = np.flatnonzero(single & np.r_[True, run[1:] != run[:-1]])
            tails = np.flatnonzero(single & np.r_[run[1:] != run[:-1], True])
            out, last = [], 0
            for begin, end in zip((ends[heads] - 1).tolist(), ends[tails].tolist()):
                out += [raw[last:begin], raw[begin:end].decode("utf-8", "lodestrata-byte").encode()]
                last = end
            raw = b"".join([*out, raw[last:]])
        return raw[1:] if self.led[ids[0]] else raw


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: the piece ids of every whole text, begin and end included, and the text they decode to.

    A null text is empty and has the ids of begin and end alone; repeated rows give a row each, null ids stay null;
    other columns are left out. Map-only: a text is cut into words slice by slice, new words of a slice are merged
    together, and a worker remembers short ones within a bound.
    """
    return _mapped(docs, vocabulary, "ids array<int>, decoded string", lambda ids, text: (ids.tolist(), text.decode("utf-8")))


def piece_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of :func:`encode_documents`, without sending ids and texts back."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids), sha(ids.astype("<u4").tobytes()), sha(text)))


def _mapped(docs: DataFrame, vocabulary: str | None, columns: str, row) -> DataFrame:
    path = vocabulary or vocabulary_path()
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            made = [row(ids, model.decode(ids)) for ids in model.encode(text.as_py() for text in batch.column(1))]
            values = zip(*made) if made else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(values, types)]], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids of every document and of the text that they decode to."""
    return piece_digests(table(spark, sf_dir, "documents"))


#: The tests hold ids and decoded texts against the library itself.
ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op13_sentencepiece": op13_sentencepiece}
