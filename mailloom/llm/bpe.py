"""BPE encoding and decoding as streaming transducers.

Encoder. A text comes in blocks. Special tokens are taken out, the rest is normalised and
cut into pre-tokens, each stage holding back only what a later block could still change:
the start of a special token, the code points after the last one that composes with
nothing before it, the last pre-tokens. The symbols of every pre-token, however short or
long, go through one transducer. Merges only ever join neighbours, and a merge can be
pre-empted only by one of a smaller rank; how far to the right a decision can be swayed is
therefore bounded by a chain of merges of falling ranks, each starting where the former's
right part ends; :func:`sufficient_lookahead` computes that bound from the merge list.
The transducer keeps a buffer of symbols, merges it, and emits the tokens that end more
than the lookahead before the buffer's end, for no later symbol can change them; a token
border splits the merges of both sides, so it goes on from there with constant memory.
What it gave for a short pre-token is remembered, in a memory of a fixed size.

Decoder. Ids become bytes, and an incremental UTF-8 machine gives text as soon as whole
code points are there; incomplete code points wait, invalid bytes become U+FFFD. Which
bytes an id stands for depends on the form: those that its byte-level symbols stand for,
with a blank for an end-of-word mark, or, as the tokenizers library does for a file without
a decoder, those of the token's string, with blanks between tokens (``joined``).

A null text counts as empty: no ids, an empty text. Every input row gives one output row,
repeated rows and null ids too; other columns take no part; an empty table gives no rows.
Memory beyond the Arrow batch does not grow with a text's length, but for a run of
combining marks, which is normalised whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import doc_rows, load, word_bpe_path
from .wordscan import buffers

BLOCK_BYTES = 1 << 16
"""Bytes of a text that are looked at together."""
MEMO_WORDS, MEMO_CHARS = 150_000, 64
"""Pre-tokens of at most so many characters whose ids a worker remembers; beyond their number the memory is begun anew."""
LONG_RUN = 1024
"""Characters of a pre-token without an end from which on its symbols are handed over as they come."""
NO_MERGE = 1 << 60
WINDOW = 4096
"""Symbols beside the lookahead that a transducer holds before it merges them."""
SHORT = 48
"""Symbols up to which a plain scan for the smallest rank is faster than a heap."""


@lru_cache(maxsize=1)
def byte_symbols() -> tuple[str, ...]:
    """The printable symbol of each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return tuple(chr(b if b in plain else next(free)) for b in range(256))


def sufficient_lookahead(merges: list[tuple[str, str]], width: dict[str, int] | None = None) -> int:
    """Symbols to the right of a token's end that can still change it.

    In rank order, ``reach[x]`` is the longest way that merges so far can go on
    from a part x into what follows it. A merge (a, b) adds b itself and, since b is
    there only if no earlier merge took one of its rightmost parts, the longest reach
    of any part on b's right spine.
    """
    reach: dict[str, int] = {}
    right: dict[str, str] = {}
    size = (lambda s: len(s.removesuffix("</w>")) or 1) if width is None else width.__getitem__
    most = 0
    for a, b in merges:
        x, beyond = b, 0
        while x:
            beyond = max(beyond, reach.get(x, 0))
            x = right.get(x, "")
        new = size(b) + beyond
        x = a
        reach[x] = max(reach.get(x, 0), new)
        right.setdefault(a + b, b)
        most = max(most, new)
    return most


class Transducer:
    """Token ids of one pre-token, fed with the bytes of its text piece by piece; holds the lookahead, a block of symbols and the tokens among them."""

    def __init__(self, encoder: Encoder, block: int = WINDOW):
        self.encoder, self.limit = encoder, encoder.lookahead + encoder.longest + block
        self.held: list[int] = []
        self.byte = -1  # the last byte so far: only the end tells whether it carries the end-of-word mark

    def feed(self, data: bytes) -> list[int]:
        """What can't change any more."""
        out: list[int] = []
        inner, held = self.encoder.inner, self.held
        if data and len(held) + len(data) < self.limit:  # nothing is stable yet
            if self.byte >= 0:
                held.append(inner[self.byte])
            held += [inner[b] for b in data[:-1]]
            self.byte = data[-1]
            return out
        for b in data:
            if self.byte >= 0:
                held.append(inner[self.byte])
                if len(held) >= self.limit:
                    self._stable(out)
            self.byte = b
        return out

    def finish(self) -> list[int]:
        """The rest."""
        out = self.encoder.merge([*self.held, self.encoder.last[self.byte]]) if self.byte >= 0 else []
        self.held, self.byte = [], -1
        return out

    def _stable(self, out: list[int]) -> None:
        """Takes off held the tokens that later symbols can't change."""
        end, limit = 0, len(self.held) - self.encoder.lookahead
        widths = self.encoder.widths
        for token in self.encoder.merge(list(self.held)):
            if end + widths[token] > limit:
                break
            end += widths[token]
            out.append(token)
        del self.held[:end]


class Memo(dict):
    """Pre-token to its ids, as little-endian bytes: whatever is not remembered goes through the transducer."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.machine = Transducer(encoder)  # begins anew whenever it has finished

    def __missing__(self, word: str) -> bytes:
        machine = self.machine
        ids = machine.feed(word.encode("utf-8", "surrogatepass"))
        ids = packed(ids + machine.finish())
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def normaliser(spec: dict | None, spaces_matter: bool) -> Callable[[str], str]:
    """The file's normaliser as a function of a text; replacing runs of white space is left out where no pre-token holds any."""
    steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
    chain: list[Callable[[str], str]] = []
    for step in steps:
        if step["type"] == "NFC":
            chain.append(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))
        elif step["type"] == "Lowercase":  # each code point on its own: no final sigma
            chain.append(lambda t: t.lower() if t.isascii() else t.replace("Σ", "σ").lower())
        elif spaces_matter or step["type"] != "Replace" or step["pattern"] != {"Regex": r"\s+"} or step["content"].strip():
            raise ValueError(f"normalizer {step} is not known")

    def run(text: str) -> str:
        for f in chain:
            text = f(text)
        return text

    return run


def starts_anew(c: str) -> bool:
    """Whether a code point composes with nothing before it; false for some others too."""
    return c.isascii() or not (unicodedata.category(c)[0] == "M" or 0x1100 <= ord(c) < 0x1200 or 0x16D40 <= ord(c) < 0x16D80)


class Encoder:
    """A tokenizer file (kind BPE, byte-level symbols, pre-tokens by a pattern) as rules: specials, normaliser, pattern, ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.special_starts = {s[:n] for s in self.specials for n in range(1, len(s))}
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], byte_level["type"], byte_level["use_regex"], byte_level["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("the pre-tokenizer is not known")
        pattern = split["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # the same for texts in ASCII: its classes are plain ranges there
        self.ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))
        self.runs = [regex.compile(x) for x in pattern.split("|") if x.endswith("]+")]  # pre-tokens without an end of their own
        self.normal = normaliser(spec["normalizer"], bool(self.pattern.search(" \t\n")))
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.strings: list[str] = [""] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        self.widths = [max(1, len(s.removesuffix(self.suffix) if self.suffix else s)) for s in self.strings]
        self.longest = max(self.widths[i] for i in self.vocab.values())
        self.memo = Memo(self)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges within a list of symbol ids, which is changed: by rank, then from the left."""
        get, made = self.ranks.get, self.made
        n = len(ids) - 1
        if n >= SHORT:
            return self._merge_long(ids)
        pairs = [get(p, NO_MERGE) for p in pairwise(ids)]
        while n > 0:
            best = min(pairs)
            if best == NO_MERGE:
                break
            i = pairs.index(best)
            ids[i] = token = made[best]
            del ids[i + 1], pairs[i]
            n -= 1
            if i:
                pairs[i - 1] = get((ids[i - 1], token), NO_MERGE)
            if i < n:
                pairs[i] = get((token, ids[i + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs (rank, place) and linked neighbours, in n log n."""
        get, made, n = self.ranks.get, self.made, len(ids)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [rank << bits | i for i, p in enumerate(pairwise(ids)) if (rank := get(p)) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & mask
            j = after[i]
            if j >= n or get((ids[i], ids[j])) != top >> bits:  # one of the two is gone or another by now
                continue
            token = ids[i] = made[top >> bits]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := get((token, ids[k]))) is not None:
                    heappush(heap, rank << bits | i)
            k = before[i]
            if k >= 0 and (rank := get((ids[k], token))) is not None:
                heappush(heap, rank << bits | k)
        return [x for x in ids if x >= 0]

    def sections(self, blocks: Iterable[str]) -> Iterator[tuple[str, bool] | int]:
        """Ids of special tokens, and between them pieces of text, each with whether a pre-token may go on beyond it; pieces may be normalised on their own."""
        held, longest = "", max(map(len, self.special_starts), default=0)
        for block in blocks:
            held += block
            if self.special_split:
                *parts, held = self.special_split.split(held)
                for k, part in enumerate(parts):
                    yield self.specials[part] if k % 2 else (part, False)
            cut = len(held)
            for n in range(min(cut, longest), 0, -1):
                if held[-n:] in self.special_starts:
                    cut -= n
                    break
            blank = max(held.rfind(" ", max(0, cut - LONG_RUN), cut), held.rfind("\n", max(0, cut - LONG_RUN), cut))
            if blank >= 0:
                yield held[:blank], False
                held = held[blank:]
                continue
            cut -= 1  # what comes may compose with the last code point
            while cut > 0 and not starts_anew(held[cut]):
                cut -= 1
            if cut > 0:
                yield held[:cut], True
                held = held[cut:]
        yield held, False

    def words(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.pattern).findall(text)

    def encode_blocks(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Ids, as little-endian bytes, of a text that comes in blocks; each as soon as it is known."""
        memo, held = self.memo, ""
        run, machine = None, Transducer(self)  # the pattern of a long pre-token that is being handed over
        for section in self.sections(blocks):
            if isinstance(section, int):
                yield packed([section])
                continue
            text, goes_on = section
            text = self.normal(text)
            if run is not None:
                m = run.match(text)
                end = m.end() if m else 0
                yield packed(machine.feed(text[:end].encode("utf-8", "surrogatepass")))
                if end == len(text) and goes_on:
                    continue
                yield packed(machine.finish())
                run, text = None, text[end:]
            text, held = held + text, ""
            if goes_on:
                found = list(self.pattern.finditer(text))
                if found and found[-1].end() == len(text):
                    at = found[-1].start()
                    if len(text) - at >= LONG_RUN:
                        run = next((r for r in self.runs if r.fullmatch(text, at)), None)
                    if run is not None:
                        yield b"".join([memo[w] for w in self.words(text[:at])])
                        yield packed(machine.feed(text[at:].encode("utf-8", "surrogatepass")))
                    else:  # a pre-token, and an apostrophe before it, may yet be cut otherwise
                        at = found[max(0, len(found) - 3)].start()
                        held = text[at:]
                        yield b"".join([memo[w] for w in self.words(text[:at])])
                    continue
            if text:
                yield b"".join([memo[w] for w in self.words(text)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_blocks([text])), "<u4")


class Decoder:
    """Ids to text, a block at a time; the state is an unfinished code point, and whether a token has come yet."""

    def __init__(self, encoder: Encoder, joined: bool):
        self.joined, self.begun = joined, False
        self.table = _joined_table(encoder) if joined else _plain_table(encoder)
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        table = self.table
        data = b"".join([table[i] for i in ids])
        if data and self.joined and not self.begun:
            data, self.begun = data[1:], True
        return self.utf8.decode(data)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def _joined_table(encoder: Encoder) -> list[bytes]:
    """A blank and the token's string."""
    return [b" " + s.encode() for s in encoder.strings]


@lru_cache(maxsize=2)
def _plain_table(encoder: Encoder) -> list[bytes]:
    """The bytes that a token's symbols stand for; an end-of-word mark is a blank, a special token its string."""
    to_byte = {s: b for b, s in enumerate(byte_symbols())}
    out = []
    for s in encoder.strings:
        ends = bool(encoder.suffix) and s.endswith(encoder.suffix)
        out.append(s.encode() if s in encoder.specials else bytes(to_byte[c] for c in (s.removesuffix(encoder.suffix) if ends else s)) + b" " * ends)
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_blocks(data: memoryview, size: int = BLOCK_BYTES) -> Iterator[str]:
    """A text's UTF-8 bytes as text, so many bytes at a time."""
    if len(data) <= size:
        yield str(data, "utf-8", "replace")
        return
    utf8 = codecs.getincrementaldecoder("utf-8")("replace")
    for k in range(0, len(data), size):
        yield utf8.decode(data[k : k + size], k + size >= len(data))


def column_blocks(column: pa.Array) -> Iterator[Iterator[str]]:
    """The blocks of each text of a column; a null is an empty text."""
    data, offsets = buffers(column)
    view, ends = memoryview(data), offsets.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield text_blocks(view[a:b])


def encode_texts(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of its whole text's ids, a row for each input row; a null text is empty."""
    path = tokenizer_path or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = [b"".join(enc.encode_blocks(x)) for x in column_blocks(part.column(1))]
                at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])])
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str | None = None, join_tokens: bool = False) -> DataFrame:
    """doc_id and the text decoded from ids; with join_tokens, the token strings with blanks between them."""
    path = tokenizer_path or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                machine = Decoder(enc, join_tokens)
                texts.append(machine.feed(ids or []) + machine.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def digests(enc: Encoder, blocks: Iterable[str]) -> tuple[int, str, str]:
    """Number and digest of a text's ids, and the digest of what they are decoded to: block by block through both machines."""
    machine, coded, decoded, n = Decoder(enc, True), hashlib.sha256(), hashlib.sha256(), 0
    for data in enc.encode_blocks(blocks):
        if data:
            coded.update(data)
            n += len(data) // 4
            decoded.update(machine.feed(np.frombuffer(data, "<u4").tolist()).encode())
    decoded.update(machine.finish().encode())
    return n, coded.hexdigest(), decoded.hexdigest()


def encode_digests(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that is decoded from them, a row for each input row."""
    path = tokenizer_path or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n, ids, decoded = zip(*(digests(enc, x) for x in column_blocks(b.column(1))), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load(spark, sf_dir, "documents"))
