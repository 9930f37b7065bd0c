"""Byte-pair encoding by backtracking over longest matches, and decoding from an offset table.

An Aho-Corasick automaton over all tokens finds the longest token at each place of a pre-token.
The encoder goes from left to right: it takes the longest token that is compatible with the one
before it and whose end was not found to lead nowhere, else the next shorter one, else it takes
the last token back.  Places that lead nowhere are marked, so each is left at most once and the
work is linear in the length.

Two tokens are compatible if the merges, done in the order of their ranks, never join what lies
across their border; a sequence is what the merges give if all its neighbours are compatible.
Only parts that touch the border can be joined across it: the token itself, the right half it was
merged from, that one's right half and so on, and likewise with left halves behind the border.
Such a part is there from its own merge until that of the next larger one.  The answers are kept
in a table by pair.

Decoding gathers the bytes of all tokens at once: their places come from a table of offsets into
one array of bytes.  The decimal forms of the ids are gathered in the same way.

Pre-tokens are those of the tokenizer file.  Where its pattern and normalisation are the known
ones, texts are cut at white space and the ids of each chunk are kept; special strings, letters
beyond Latin and other files go through the normaliser and pre-tokeniser of the file, never its
merges.

Defined results: a null or empty text has no tokens, and decodes to the empty text; repeated rows
are encoded each; an empty table gives no rows; a null id is kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts, worker_cache
from .packing import CACHE_ENTRIES, ChunkEncoder, composed

BLOCK_BYTES = 1_000_000
PAIR_ENTRIES = 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level tokenizers write bytes with: printable bytes stand for
    themselves, the others take the letters from U+0100 on in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Merges:
    """Tokens as strings of symbols: a byte is its number, the last byte of a word 256 more."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        import ahocorasick

        letters, self.end = byte_letters(), 256 if end else 0

        def symbols(token: str) -> str | None:
            last = bool(end) and token.endswith(end)
            raw = [letters.get(c) for c in (token[: -len(end)] if last else token)]
            if not raw or None in raw:
                return None
            return "".join(map(chr, [*raw[:-1], raw[-1] + 256 * last]))

        self.of = {s: i for t, i in vocabulary.items() if (s := symbols(t))}
        needed = {chr(x) for x in range(256)} | {chr(x + self.end) for x in range(256)}
        if needed - self.of.keys():
            raise ValueError("some byte has no token")
        self.rank = {(vocabulary[a], vocabulary[b]): n for n, (a, b) in enumerate(merges)}
        joined = {pair: vocabulary[a + b] for pair, (a, b) in zip(self.rank, merges, strict=True)}
        if len(set(joined.values())) < len(joined):
            raise ValueError("some token comes from two merges")
        halves = {token: pair for pair, token in joined.items()}
        self.right = {token: self.spine(token, 1, halves) for token in self.of.values()}
        self.left = {token: self.spine(token, 0, halves) for token in self.of.values()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token that the merges never give would not be found by them either.
        given = {i for s, i in self.of.items() if len(s) == 1}
        for (a, b), token in joined.items():
            if a in given and b in given and self.compatible(a, b, before=self.rank[a, b]):
                given.add(token)
        kept = {s: i for s, i in self.of.items() if i in given}
        self.size = {i: len(s) for s, i in kept.items()}
        self.shorter = {i: next((kept[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in kept), -1) for s, i in kept.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in kept.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()

    def spine(self, token: int, side: int, halves: dict) -> list[tuple[int, float]]:
        """The parts of a token at its border, and the rank of the merge that ends each."""
        out, until = [(token, float("inf"))], float("inf")
        while token in halves:
            until, token = self.rank[halves[token]], halves[token][side]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank under ``before`` joins anything across the border of a and b.

        Of equal merges the left one is done first, so the part behind the border is still there
        at the rank of its own end, the part before it is not.
        """
        for x, until_x in self.right[a]:
            for y, until_y in self.left[b]:
                rank = self.rank.get((x, y))
                if rank is not None and rank < until_x and rank <= until_y and rank < before:
                    return False
        return True

    def fits(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.compatible(a, b)
        return known

    def encode(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        if not raw:
            return []
        word = raw[:-1].decode("latin-1") + chr(raw[-1] + self.end)
        if (whole := self.of.get(word)) in self.size:
            return [whole]
        longest = [-1] * len(word)
        for last, (token, n) in self.automaton.iter(word):
            longest[last - n + 1] = token  # of one start the longer matches come later
        size, shorter, open_at = self.size, self.shorter, bytearray(b"\1") * (len(word) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            while token >= 0 and not (open_at[at + size[token]] and (not out or self.fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < len(word) else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out


class Gather:
    """Pieces of bytes by number, put end to end for many numbers at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each number's bytes end among them."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.data[np.repeat(self.offset[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Codec(ChunkEncoder):
    """Encoder and decoder of one tokenizer file; chunks and pre-tokens are kept, up to a bound."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model, decoder = own["model"], (own.get("decoder") or {}).get("type")
        steps = own["pre_tokenizer"].get("pretokenizers", [own["pre_tokenizer"]])
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or steps[-1]["type"] != "ByteLevel" or decoder not in (None, "ByteLevel"):
            raise ValueError("only byte-level BPE without dropout, prefixes or byte fallback")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        added = {t["content"]: t["id"] for t in own["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in own["added_tokens"]):
            raise ValueError("added tokens must be matched as they are")
        self.special = added
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.letters = byte_letters()
        names = {i: t for t, i in (model["vocab"] | added).items()}
        if decoder:
            pieces = [bytes(self.letters.get(c, 0) for c in names[i]) if i in names and names[i] not in added else names.get(i, "").encode() for i in range(max(names) + 1)]
        else:
            pieces = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.spaced, self.bytes_of = not decoder, Gather(pieces)
        self.digits_of = Gather([b"%d " % i for i in range(max(names) + 1)])

    def part(self, raw: bytes) -> bytes:
        """The ids of a pre-token, kept."""
        ids = self.parts.get(raw)
        if ids is None:
            ids = np.array(self.merges.encode(raw), dtype="<u4").tobytes()
            if len(self.parts) >= CACHE_ENTRIES:
                self.parts.clear()
            if len(raw) <= 256:
                self.parts[raw] = ids
        return ids

    def direct(self, some: list[str]) -> list[bytes]:
        """Ids by way of the file's own normaliser and pre-tokeniser."""
        out, normal, before = [], self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        for text in some:
            ids = []
            for piece in self.at_special.split(text) if self.at_special else [text]:
                if piece in self.special:
                    ids.append(np.uint32(self.special[piece]).tobytes())
                elif piece:
                    words = before.pre_tokenize_str(normal.normalize_str(piece) if normal else piece)
                    ids += [self.part(bytes(map(self.letters.__getitem__, w))) for w, _ in words]
            out.append(b"".join(ids))
        return out

    def settle(self, chunks: set[str]) -> None:
        """Put the ids of every chunk into the cache."""
        find, part, cache = self.find, self.part, self.cache
        for c in chunks:
            if "<|" in c or not (c.isascii() or composed(c)):
                cache[c] = self.direct([c])[0]
            elif c.isalpha():
                cache[c] = part(c.lower().encode())
            else:
                cache[c] = b"".join([part(p.encode()) for p in find(c.lower())])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, as UTF-8."""
        raw, _ = self.bytes_of(ids)
        text = raw.tobytes()
        return text[:-1] if self.spaced else text.decode(errors="replace").encode()


def codec_of(path: str) -> Codec:
    """The worker's codec for a file."""
    held = worker_cache(f"codec:{path}")
    if "codec" not in held:
        held["codec"] = Codec(path)
    return held["codec"]


def digests(codec: Codec, block: list[str]) -> list[tuple[int, str, str]]:
    """Number of tokens, digest of the ids, digest of the decoded text, for each text of a block."""
    packed = codec.encode(block)
    ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
    counts = np.array([len(p) // 4 for p in packed])
    last = np.cumsum(counts)
    (digits, digit_ends), (raw, raw_ends) = codec.digits_of(ids), codec.bytes_of(ids)
    to = lambda ends: np.r_[0, ends][last].tolist()
    at, out = (0, 0), []
    for n, a, b in zip(counts.tolist(), to(digit_ends), to(raw_ends), strict=True):
        own, text = digits[at[0] : a], raw[at[1] : b]
        at = (a, b)
        if codec.spaced:
            decoded = hashlib.sha256(text[:-1])
        else:
            decoded = hashlib.sha256(text.tobytes().decode(errors="replace").encode())
        out.append((n, hashlib.sha256(own[:-1]).hexdigest(), decoded.hexdigest()))
    return out


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)

        def flush(keys: list, block: list[str]) -> pa.RecordBatch:
            n, ids, decoded = zip(*digests(codec, block), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            keys, block, held = [], [], 0
            for key, text in zip(*batch.columns, strict=True):
                keys.append(key.as_py())
                block.append(text.as_py())
                held += len(block[-1])
                if held >= BLOCK_BYTES:
                    yield flush(keys, block)
                    keys, block, held = [], [], 0
            if keys:
                yield flush(keys, block)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                ids = [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in codec.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give the empty text, an id that no token has raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                texts_ = [codec.decode(np.array(x or [], dtype=np.int64)).decode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts_, pa.string())], ["doc_id", "text"])

    return rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
