"""Whole-text encoding with the tokenizers library, once for each distinct chunk.

A text is cut where no tokenizer decision can cross; each worker keeps the ids of the chunks
that it has met (known by 128-bit hashes), so that a chunk costs one call of the library per worker and a lookup after.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from millrace.llm.arrowio import spans_to_places, words_of

#: Chunks that a worker remembers; beyond that it forgets those that it has met the least.
CACHE_CHUNKS = 1_000_000

#: Characters above ASCII that some regular-expression engine counts as white space or joins to a neighbour.
_WIDE_SPACE = "\x80-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
#: A chunk may start before a space that one of these characters follows.
_OPENS = f"^[^\x00-\x20\x7f{_WIDE_SPACE}]"


def byte_characters() -> list[str]:
    """The printable character by which byte-level BPE writes each byte: printable Latin-1 bytes
    stand for themselves, the others follow from code point 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """A byte-level BPE of the tokenizers library that merges as the ranks say.

    The rank rule joins any neighbours whose concatenation is a token, lowest rank first. The
    library wants the pairs: every split of each token into two tokens, in the order of ranks.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    spelled = {t: "".join(shown[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((spelled[token[:cut]], spelled[token[cut:]]))
    made = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)  # its pattern is the rank files' one
    return made


class Encoder:
    """Ids of texts. kind: "byte" (a chunk starts before a single space), "word" (white space is dropped).

    Strings of special tokens inside a text give what the library gives: the special token's id, or
    with plain=True the ids of ordinary text.
    """

    def __init__(self, path: str, kind: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.ranks = read_ranks(path) if path.endswith(".tiktoken") else None
        self.library = tokenizer_of_ranks(self.ranks) if self.ranks else Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        named = [] if plain else [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        # white space before a special token ends a text for the library, so no chunk starts at one
        self.starts_special = f"^({'|'.join(named)})" if named else None
        self.vocabulary = self.library.get_vocab_size()
        self._forget()

    def _ids_of(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of each id of a byte-level vocabulary."""
        if self.ranks:
            return {r: t for t, r in self.ranks.items()}
        back = {c: b for b, c in enumerate(byte_characters())}
        return {i: bytes(back[c] for c in t) for t, i in self.library.get_vocab(False).items()}

    def _forget(self) -> None:
        """A chunk is known by its 128-bit hash: `key` is sorted, `check` is the other half."""
        none = np.zeros(0, np.uint64)
        self.key, self.check, self.start, self.length, self.met = none, none, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint16 if self.vocabulary < 1 << 16 else np.uint32), 0

    def _shrink(self) -> None:
        """Keep the better half of the chunks: those met in the most slices."""
        order = np.argsort(-self.met, kind="stable")
        keep = np.sort(order[: len(order) // 2])
        keep = keep[self.met[keep] > 1]
        size = self.length[keep].astype(np.int64)
        ids = self.flat[spans_to_places(self.start[keep], size)]
        self.key, self.check, self.length, self.met = self.key[keep], self.check[keep], self.length[keep], self.met[keep] // 2
        self.start = np.cumsum(size) - size
        self.flat[: len(ids)], self.used = ids, len(ids)

    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, (self.key[at] == key) & (self.check[at] == check)

    def _places(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the ids of each of some distinct chunks begin, and their number."""
        if len(self.key) > CACHE_CHUNKS:
            self._shrink()
        digests = b"".join(map(xxhash.xxh3_128_digest, chunks.cast(pa.binary()).to_pylist()))
        check, key = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
        at, known = self._find(key, check)
        new = np.flatnonzero(~known)
        start, length = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int32)
        start[known], length[known] = self.start[at[known]], self.length[at[known]]
        self.met[at[known]] += 1
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            ids = self._ids_of(chunks.take(pa.array(part)).to_pylist())
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            total = int(n.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), self.flat.dtype, total)
            start[part], length[part] = self.used + np.cumsum(n) - n, n
            self.used += total
        if len(new):
            order = new[np.argsort(key[new], kind="stable")]
            order = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
            if len(self.key):  # another chunk of the same half hash is remembered
                order = order[self.key[np.minimum(np.searchsorted(self.key, key[order]), len(self.key) - 1)] != key[order]]
            into = np.searchsorted(self.key, key[order])
            self.key, self.check = np.insert(self.key, into, key[order]), np.insert(self.check, into, check[order])
            self.start, self.length = np.insert(self.start, into, start[order]), np.insert(self.length, into, length[order])
            self.met = np.insert(self.met, into, np.ones(len(order), np.int32))
        return start, length

    def _chunks(self, text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        if self.kind == "word":
            return words_of(text)
        parts = pc.split_pattern(text, " ")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        opens = pc.match_substring_regex(coded.dictionary, _OPENS).to_numpy(zero_copy_only=False)
        if self.starts_special:
            opens = opens & ~pc.match_substring_regex(coded.dictionary, self.starts_special).to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy()
        ok = opens[code]
        first = offsets[:-1]
        ok[first] = True
        spaced = pc.binary_join_element_wise("", coded.dictionary, " ")  # distinct chunks, each with its space
        lead = flat.take(pa.array(first))
        if ok.all():
            table = pa.concat_arrays([spaced, lead])
            code = code.astype(np.int64)
            code[first] = len(spaced) + np.arange(len(first))
            return pa.DictionaryArray.from_arrays(pa.array(code), table, safe=False), offsets
        # a part that doesn't open a chunk goes to the chunk before it
        begins = np.flatnonzero(ok)
        ends = np.append(begins[1:], len(ok))
        code = code.astype(np.int64)[begins]
        at_first = np.searchsorted(begins, first)
        code[at_first] = len(spaced) + np.arange(len(first))
        more, lead_list = [], lead.to_pylist()
        is_first = np.zeros(len(begins), bool)
        is_first[at_first] = True
        for i in np.flatnonzero(ends - begins > 1):
            joined = " ".join(flat.slice(begins[i], ends[i] - begins[i]).to_pylist())
            if is_first[i]:
                lead_list[code[i] - len(spaced)] = joined
            else:
                code[i] = len(spaced) + len(first) + len(more)
                more.append(f" {joined}")
        table = pa.concat_arrays([spaced, pa.array(lead_list + more, pa.string())])
        return pa.DictionaryArray.from_arrays(pa.array(code), table, safe=False), np.searchsorted(begins, offsets)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's ids begin (one more place than texts)."""
        if not len(text):
            return np.zeros(0, self.flat.dtype), np.zeros(1, np.int64)
        chunks, offsets = self._chunks(text)
        code, used = chunks.indices.to_numpy().astype(np.int64), np.zeros(len(chunks.dictionary), bool)
        used[code] = True
        wanted = np.flatnonzero(used)
        distinct = chunks.dictionary.take(pa.array(wanted)).dictionary_encode()
        start, length = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        if len(wanted):
            first, n = self._places(distinct.dictionary)
            back = distinct.indices.to_numpy()
            start[wanted], length[wanted] = first[back], n[back]
        n = length[code]
        ids = self.flat[spans_to_places(start[code], n)]
        return ids, np.concatenate([[0], np.cumsum(n)])[offsets]


class PieceEncoder(Encoder):
    """Ids of texts by a sentencepiece model that puts a space before each text.

    Where no piece holds a space after another character, no merge crosses from a character to the
    space after it, so a text is cut there; with other vocabularies each text is one chunk.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.kind, self.ranks = "piece", None
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(self.vocabulary)]
        self.cuts = not any(re.search("[^\u2581]\u2581", p) for p in self.pieces)
        self._forget()

    def _ids_of(self, chunks: list[str]) -> list[list[int]]:
        return self.library.encode(chunks, num_threads=1)

    def token_bytes(self) -> dict[int, bytes]:
        """Pieces in UTF-8 with U+2581 as space; byte pieces are their byte."""
        return {i: bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(self.pieces)}

    def _chunks(self, text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """A chunk is the spaces (but one, which the model adds) and the word after them."""
        if not self.cuts:
            return text.dictionary_encode(), np.arange(len(text) + 1)
        parts = pc.split_pattern(text, " ")
        flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        ok = np.concatenate([[True], full[:-1]])
        ok[offsets[1:] - 1] &= full[offsets[1:] - 1]  # one space at a text's end goes with the word before
        ok[offsets[:-1]] = True
        if ok.all():
            return flat.dictionary_encode(), offsets
        begins = np.flatnonzero(ok)
        size = np.diff(np.append(begins, len(ok)))
        coded = flat.take(pa.array(begins + size - 1)).dictionary_encode()
        code, more = coded.indices.to_numpy().astype(np.int64), []
        for i in np.flatnonzero(size > 1):
            code[i] = len(coded.dictionary) + len(more)
            more.append(" ".join(flat.slice(int(begins[i]), int(size[i])).to_pylist()))
        table = pa.concat_arrays([coded.dictionary, pa.array(more, pa.string())])
        return pa.DictionaryArray.from_arrays(pa.array(code), table, safe=False), np.searchsorted(begins, offsets)


class ByteTable:
    """The bytes of each id of a vocabulary, to decode with."""

    def __init__(self, encoder: Encoder):
        known = encoder.token_bytes()
        rows = [known.get(i, b"") for i in range(max(known) + 1)]
        self.length = np.fromiter(map(len, rows), np.int64, len(rows))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(rows), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where the bytes of each text begin. Characters that several ids
        share come out whole, as bytes are joined before anything reads them as characters."""
        n = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[spans_to_places(self.start[ids], n)], ends[offsets]

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one code point of each id of one text; an id that holds part of a
        character covers that character."""
        data, _ = self.decode(ids, np.array([0, len(ids)]))
        opens = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = np.cumsum(self.length[ids])
        return np.maximum(opens[np.minimum(ends - self.length[ids] + 1, len(data))] - 1, 0), opens[ends]


_MADE: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, kind: str, plain: bool = False) -> Encoder:
    """This worker's encoder for a vocabulary file; kind "piece" is a sentencepiece model."""
    if (path, kind, plain) not in _MADE:
        _MADE[path, kind, plain] = PieceEncoder(path) if kind == "piece" else Encoder(path, kind, plain)
    return _MADE[path, kind, plain]
