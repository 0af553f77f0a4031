"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import table
from .spans import PAD, gather, hashes, slices, small_batches, texts

TOKENIZER = "byte_bpe_50k.json"
GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)
#: A chunk of letters only, with a space before it or not: one word to the pre-tokenizer, whatever its length.
RUN = re.compile("[ ]?(?:[A-Za-z]+|[倀-迿]+)")
LONG = 256

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
MARK = np.zeros(256, bool)  # ASCII that is neither a letter, a digit nor a kind of space
MARK[33:127] = True
MARK &= ~ALNUM
# last byte, and the one before it, of characters that may count as space; also the separators 1C to 1F
LAST, BEFORE = np.zeros(256, bool), np.zeros(256, bool)
LAST[[*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
BEFORE[[0xC2, 0x80, 0x81, 0x9A, 0xA0]] = True
ODD = SPACE.copy()
ODD[0x1C:0x20] = True
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASS = (1 * SPACE + 2 * ALNUM + 4 * MARK + 8 * ODD + 16 * LAST + 32 * BEFORE).astype(np.uint8)
WIDE_MARKS = ["、", "。", "，", "！", "？", "：", "；"]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def common_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes are of printable ASCII, a line end, or one of the Latin-1 letters."""
    out = ((data >= 32) & (data < 127)) | (data == 10) | (data == 0xC3)
    out[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return out


def sure_cuts(data: np.ndarray) -> np.ndarray:
    """Whether the pre-tokenizer ends a word before byte i whatever else the text holds.

    It does where space follows something that is none, and where a mark follows an ASCII letter or digit or a wide
    mark an ideograph: no alternative of its pattern has such a pair inside. The predicate sees four bytes, so
    equal passages are cut alike in all documents.
    """
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    kind, here = CLASS.take(data), data[1:]
    may_be_space = kind[:-1] >> 3
    may_be_space[1:] |= (kind[1:-1] >> 4) & (kind[:-2] >> 5)
    cut[1:] = ((kind[1:] & ~may_be_space & 1) | ((kind[1:] >> 2) & (kind[:-1] >> 1) & 1)).view(bool)
    wide = np.flatnonzero((here == 0xE3) | (here == 0xEF)) + 1
    wide = wide[(wide >= 3) & (wide < len(data) - 2)]
    if len(wide):
        wide = wide[(data[wide - 3] >= 0xE5) & (data[wide - 3] <= 0xE8)]
        code = (data[wide].astype(np.int32) << 16) | (data[wide + 1].astype(np.int32) << 8) | data[wide + 2]
        cut[wide[np.isin(code, [int.from_bytes(m.encode()) for m in WIDE_MARKS])]] = True
    return cut


def gear_ends(data: bytes, bits: int = 6, window: int = 16) -> list[int]:
    """Ends of chunks, between characters, where a rolling hash of the last `window` bytes has `bits` zero bits."""
    raw = np.frombuffer(data, np.uint8)
    g = GEAR[raw]
    h = g.copy()
    for t in range(1, min(window, len(g))):
        h[t:] += g[:-t] << np.uint32(t)
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    at = at[(at >= window) & (at < len(data))]
    while len(at) and (inside := (raw[at] & 0xC0) == 0x80).any():  # to the end of the character
        at[inside] += 1
        at = at[at < len(data)]
    return [*np.unique(at).tolist(), len(data)]


class Codec:
    """Encodes and decodes as the tokenizer does, from remembered chunks.

    Texts are cut into content-defined chunks. At a sure cut the pre-tokenizer begins a new word in every context, so
    chunks encoded apart are exact there. A long run of letters has no sure cut; it is cut where a rolling hash
    hits, and each join is repaired: the last tokens before it and the first behind it are encoded anew, ever more of
    them, until the result agrees with its neighbours on both sides (two neighbouring tokens agree if their
    joined text encodes to just them; where all neighbours agree, the whole is the encoding). A chunk is encoded
    once in a worker process and remembered by its hash, in a memo that all its documents and tasks share and that
    starts anew at `most` bytes. Tokenizers of another kind than byte-level BPE get whole texts.
    """

    def __init__(self, path: str, most: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.chunked = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.chunked = self.chunked and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        self.added = [a["content"].encode() for a in added]
        self.most = most
        self.forget()
        self.parts = None
        self.quick = self.same_in_ranks(spec["model"]) if self.chunked else None

    def forget(self) -> None:
        self.keys, self.at, self.n, self.known = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.arena, self.used = np.zeros(1 << 16, np.uint32), 0
        self.slots = np.full(1 << 18, -1, np.int32)

    def same_in_ranks(self, model: dict):
        """The vocabulary as ranks, for text of common_bytes, or None where that might differ.

        Merging the neighbours whose joined token has the least rank gives the same as the list of merges if the
        list's tokens rise in id and every token encodes to itself: two neighbours with a joined token in the
        vocabulary are then the pair that the list names, as otherwise that token could not be reached from its bytes.
        """
        try:
            import tiktoken
        except ImportError:
            return None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        ids = [vocab.get(a + b, -1) for a, b in merges]
        singles = {w for w in vocab if len(w) == 1}
        if model.get("dropout") or model.get("ignore_merges") or ids != sorted(set(ids)) or len(singles) != 256 or any(vocab[w] >= ids[0] for w in singles):
            return None
        one = self.tok.model.tokenize
        known = {w: i for w, i in vocab.items() if w in singles or i >= ids[0] and i <= ids[-1]}
        if len(known) != len(ids) + 256 or any(len(t := one(w)) != 1 or t[0].id != i for w, i in known.items()):
            return None
        self.bytes_of(np.zeros(0, np.int64))
        arena, at, n = self.parts
        ranks = {arena[at[i] : at[i] + n[i]].tobytes(): i for i in known.values()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is remembered, -1 if it is not: open addressing, all hashes together."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (h & mask).astype(np.int64)
        out = self.slots[slot]
        other = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(other):
            slot[other] = (slot[other] + 1) & int(mask)
            got = self.slots[slot[other]]
            out[other] = got
            other = other[(got >= 0) & (self.keys[got] != h[other])]
        return out

    def place(self, numbers: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.keys[numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & mask

    def plain(self, parts: list[str]) -> list[list[int]]:
        out, run, size = [], [], 0
        for i, p in enumerate(parts):
            run.append(p)
            size += len(p)
            if size > 100_000 or i == len(parts) - 1:
                out += [e.ids for e in self.tok.encode_batch_fast(run, add_special_tokens=False)]
                run, size = [], 0
        return out

    def agree(self, a: int, b: int) -> bool:
        x, y = (self.tok.id_to_token(t) for t in (a, b))
        both = self.bytes_of(np.array([a, b])).tobytes()
        try:
            text = both.decode()
        except UnicodeDecodeError:
            # part of a character: the pair is looked at among the model's own pieces
            return [t.id for t in self.tok.model.tokenize(x + y)] == [a, b]
        return self.plain([text])[0] == [a, b]

    def run_of_letters(self, data: bytes) -> np.ndarray:
        """The ids of one long word, from chunks whose joins are repaired."""
        ends = gear_ends(data)
        out: list[int] = []
        for n, ids in enumerate(self.plain([data[a:b].decode() for a, b in zip([0, *ends], ends)])):
            if not n or not out:
                out += ids
                continue
            take = 1
            while not self.agree(out[-1], ids[0]):
                left, right = out[-take:], ids[:take]
                try:
                    window = self.plain([self.bytes_of(np.array(left + right)).tobytes().decode()])[0]
                except UnicodeDecodeError:
                    take += 1
                    if take > len(out) and take > len(ids):
                        return np.array(self.plain([data.decode()])[0], np.uint32)
                    continue
                fits = (take >= len(out) or self.agree(out[-take - 1], window[0])) and (take >= len(ids) or self.agree(window[-1], ids[take]))
                if fits:
                    out[-take:], ids = window, ids[take:]
                    break
                take *= 2
            out += ids
        return np.array(out, np.uint32)

    def strung(self, data: bytes, lens: np.ndarray, common: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """How many ids each has, and all ids, of chunks that follow one another in data at sure cuts: encoded as one text and told apart by their bytes."""
        self.bytes_of(np.zeros(0, np.int64))
        ids = np.array(self.quick.encode_ordinary(data.decode()) if common and self.quick else self.plain([data.decode()])[0], np.uint32)
        ends, want = np.cumsum(self.parts[2][ids]), np.cumsum(lens)
        at = np.searchsorted(ends, want)
        if len(ends) != at[-1] + 1 or (ends[at] != want).any():
            return None
        return np.diff(at, prepend=-1), ids

    def chunks(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which chunks, how many ids each has, their ids), some chunks at a time, each chunk once."""
        first, last, before = buf[starts], buf[starts + lens - 1], buf[np.maximum(starts + lens - 2, 0)]
        string = (SPACE[first] | MARK[first]) & ~ODD[last] & ~(LAST[last] & BEFORE[before]) & (lens <= LONG)
        alone = np.flatnonzero(~string)
        odd = np.concatenate([[0], np.cumsum(~common_bytes(buf))])
        common = odd[starts + lens] == odd[starts]
        for after_mark, of_common in ((False, False), (False, True), (True, False), (True, True)):
            which = np.flatnonzero(string & (MARK[first] == after_mark) & (common == of_common))
            for at in range(0, len(which), 20_000):
                some = which[at : at + 20_000]
                n = lens[some]
                data = gather(buf, starts[some], n)
                if after_mark:  # a letter goes before each, as a mark needs one to be a sure cut
                    where = np.repeat(np.cumsum(n) - n, 2)
                    data = np.insert(data, where, np.tile(np.frombuffer(b" a", np.uint8), len(n)))
                    n = np.stack([np.full(len(n), 2), n], axis=1).reshape(-1)
                raw = data.tobytes()
                got = None if any(c in raw for c in self.added) else self.strung(raw, n, of_common)
                if got is None:
                    alone = np.concatenate([alone, some])
                    continue
                counts, ids = got
                if after_mark:
                    counts = counts[1::2]
                    own = np.repeat(np.tile([False, True], len(some)), got[0])
                    ids = ids[own]
                yield some, counts, ids
        parts = [buf[a : a + n].tobytes() for a, n in zip(starts[alone], lens[alone])]
        long = [i for i, p in enumerate(parts) if len(p) > LONG and RUN.fullmatch(p.decode())]
        found: dict[int, np.ndarray] = {i: self.run_of_letters(parts[i]) for i in long}
        rest = [i for i in range(len(parts)) if i not in found]
        found |= dict(zip(rest, self.plain([parts[i].decode() for i in rest])))
        if parts:
            lists = [np.asarray(found[i], np.uint32) for i in range(len(parts))]
            yield alone, np.array([len(x) for x in lists], np.int64), np.concatenate(lists)

    def learn(self, hashed: np.ndarray, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        first = self.known
        for which, n, ids in self.chunks(buf, starts, lens):
            while self.used + len(ids) > len(self.arena):
                self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), np.uint32)])
            self.arena[self.used : self.used + len(ids)] = ids
            lo, hi = self.known, self.known + len(which)
            while hi > len(self.keys):
                self.keys, self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.at, self.n))
            self.keys[lo:hi], self.at[lo:hi], self.n[lo:hi], self.known = hashed[which], self.used + np.cumsum(n) - n, n, hi
            self.used += len(ids)
        if 2 * self.known > len(self.slots):
            self.slots = np.full(len(self.slots) * 4, -1, np.int32)
            first = 0
        self.place(np.arange(first, self.known, dtype=np.int32))

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, bytes) of texts -> how many ids each has, and all ids."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = data[lo:hi].tobytes()
        if not self.chunked:
            ids = self.plain([raw[a - lo : b - lo].decode() for a, b in zip(offsets[:-1], offsets[1:])])
            return np.array([len(x) for x in ids], np.int64), np.array([t for x in ids for t in x], np.uint32)
        if 32 * self.known + 4 * self.used > self.most:
            self.forget()
        buf = np.frombuffer(raw + PAD, np.uint8)
        cut = sure_cuts(buf[: hi - lo])
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                cut[at + 1 : at + len(content)] = False
                at = raw.find(content, at + 1)
        own = offsets[:-1] - lo
        cut[own[own < len(cut)]] = True
        starts = np.flatnonzero(cut)
        lens = np.diff(np.append(starts, hi - lo))
        h = hashes(buf, starts, lens)
        at = self.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, once = np.unique(h[new], return_index=True)
            self.learn(fresh, buf, starts[new[once]], lens[new[once]])
            at[new] = self.find(h[new])
        n = self.n[at]
        before = np.concatenate([[0], np.cumsum(n)])
        bounds = before[np.searchsorted(starts, np.append(own, hi - lo))]
        return np.diff(bounds), gather(self.arena, self.at[at], n)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the tokens of a byte-level vocabulary stand for."""
        if self.parts is None:
            # byte-level alphabets show a printable byte as itself and the others, in order, from U+0100 on
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            letter = {chr(b): b for b in shown}
            for i, b in enumerate(b for b in range(256) if b not in shown):
                letter[chr(256 + i)] = b
            words = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
            raw = [bytes(letter[c] for c in w) if all(c in letter for c in w) else w.encode() for w in words]
            n = np.array([len(r) for r in raw], np.int64)
            self.parts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(n) - n, n
        arena, at, n = self.parts
        return gather(arena, at[ids], n[ids])

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids -> (offsets, bytes) of the texts."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if self.chunked and (not len(ids) or int(ids.max()) < self.tok.get_vocab_size(with_added_tokens=True)):
            data = self.bytes_of(ids)
            at = np.concatenate([[0], np.cumsum(self.parts[2][ids])])[bounds]
            begins = at[:-1][np.diff(at) > 0]
            try:
                data.tobytes().decode()
                if not ((data[begins] & 0xC0) == 0x80).any():
                    return at, data
            except UnicodeDecodeError:
                pass
        out = [self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(bounds[:-1], bounds[1:])]
        return np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64), np.frombuffer(b"".join(out), np.uint8)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One of each worker process, with its memo, for all its tasks."""
    return Codec(path)


def column(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _mapped(docs: DataFrame, columns: list[str], source: str, made: list[tuple[str, object]], work) -> DataFrame:
    """docs' `columns`, as they are, and the columns `made` by work(codec, offsets, bytes) from slices of `source`."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = texts(b.column(source))
            for lo, hi in slices(offsets):
                out = work(offsets[lo : hi + 1], data)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in columns), *out], names=[*columns, *(n for n, _ in made)])

    kept = docs.select(*columns).schema
    return docs.select(*dict.fromkeys([*columns, source])).mapInArrow(run, StructType([*kept, *(StructField(n, t) for n, t in made)]))


def _ids(counts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return column(pa.binary(), 4 * np.concatenate([[0], np.cumsum(counts)]), ids.astype("<u4").view(np.uint8))


def bpe_encode(docs: DataFrame, tokenizer: str = TOKENIZER, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> doc_id, the columns `carried`, ids (little-endian unsigned 32-bit integers).

    Null text is empty and gives no ids; every row, repeated or with a null doc_id, gives a row; an empty table gives
    an empty result; other columns are left out, whatever their names. A worker holds a few MB of texts at a time, or one
    text. The tokenizer's file must be installed on the executors, where its path is resolved.
    """
    return _mapped(docs, ["doc_id", *carried], "text", [("ids", BinaryType())], lambda o, d: [_ids(*codec(tokenizer_path(tokenizer)).encode(o, d))])


def bpe_decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) -> doc_id, ids, decoded text; null ids are none, and bytes that are no UTF-8 are replaced as the library does."""

    def work(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        ids = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), "<u4")
        counts = np.diff(offsets) // 4
        return [_ids(counts, ids), column(pa.string(), *codec(tokenizer_path(tokenizer)).decode(counts, ids))]

    return _mapped(encoded, ["doc_id"], "ids", [("ids", BinaryType()), ("decoded", StringType())], work)


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) -> doc_id, ids, decoded text: bpe_encode and bpe_decode in one worker, with one tokenizer."""

    def work(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        c = codec(tokenizer_path(tokenizer))
        counts, ids = c.encode(offsets, data)
        return [_ids(counts, ids), column(pa.string(), *c.decode(counts, ids))]

    return _mapped(docs, ["doc_id"], "text", [("ids", BinaryType()), ("decoded", StringType())], work)


def digest(docs: DataFrame) -> DataFrame:
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return round_trip(docs).select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded; see bpe_encode for nulls, empty and repeated rows."""
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))
