"""Byte-level BPE encoding and decoding: greedy proposal, vectorised pair checks, exact merging for the words that fail."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .text import from_driver, slices, small_batches, texts, to_tasks

#: How text is split before the merges; a fixed value of the vocabulary. White space is Unicode's, as in the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << np.int64(40)
#: White space below U+0250, and a search for anything above it.
SPACE, BEYOND = r"\t-\r \x85\xa0", re.compile("[^\x00-\u024f]").search
#: Longer words are merged one by one.
LONG_WORD = 64
#: Characters that are split into words at once; the lists of words take some twenty times as many bytes.
PIECE_CHARS = 1_000_000
#: Words whose ids a task remembers at once.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 is itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the merge that makes each of them, and the special strings."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[ch] for ch in name): i for name, i in names.items() if name not in self.special}
        self.size = max([*names.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for raw, i in self.ids.items():
            self.bytes[i] = raw
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.longest = max(map(len, self.ids))
        self.made = np.full(self.size, -1, np.int64)  # the rank of the merge that makes a token, -1 for bytes
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (names[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[self.bytes[a] + self.bytes[b]]
            self.ranks[a, b] = (rank, whole)
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        codes = np.array([a * self.size + b for a, b in self.ranks], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_ranks = codes[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        self.wholes = np.array([w for _, w in self.ranks.values()], np.int64)
        self.matcher = None
        self.atoms = [self.ids[bytes([b])] for b in range(256)]
        # Tokens that merging their own bytes doesn't give can't stand in a proposal.
        self.ids = {raw: i for raw, i in self.ids.items() if len(raw) == 1 or self.merge(raw) == [i]}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between neighbours a and b outlasts all merges, for arrays of pairs.

        While merging goes on, the border lies between a token on a's right edge and one on b's left edge. Both edges are
        undone from the latest merge back; the border falls if the pair at hand merges before either side grows on. Equal
        merges run from left to right: the left side's growth goes first, the right side's comes after.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        grow_a, grow_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(live):
            rank = self.rank_of(a, b)
            fall = (rank < grow_a) & (rank <= grow_b)
            ok[live[fall]] = False
            go = ~fall & ((self.made[a] >= 0) | (self.made[b] >= 0))
            live, a, b, grow_a, grow_b = live[go], a[go], b[go], grow_a[go], grow_b[go]
            undo_a = self.made[a] > self.made[b]
            grow_a, grow_b = np.where(undo_a, self.made[a], grow_a), np.where(undo_a, grow_b, self.made[b])
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from the left over all words at once: token ids and the word that each belongs to."""
        if self.matcher is None:
            self.matcher = ahocorasick.Automaton()
            for raw, i in self.ids.items():
                self.matcher.add_word(raw.decode("latin-1"), i)
            self.matcher.make_automaton()
        # A letter above Latin-1 stands between words; no token holds it.
        ends, ids = np.array(list(self.matcher.iter_long("\u0100".join(w.decode("latin-1") for w in words))), np.int64).reshape(-1, 2).T
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return ids, np.searchsorted(stops, ends, side="right")

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words of one length: each pass makes one merge in every word that has any left."""
        toks = np.array(self.atoms, np.int64)[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)]
        ranks = self.rank_of(toks[:, :-1], toks[:, 1:])
        out = [b""] * len(words)
        live = np.arange(len(words))
        while len(live):
            go = ranks.min(axis=1, initial=NEVER) < NEVER
            width, plain = 4 * toks.shape[1], toks[~go].astype(np.int32).tobytes()
            for n, i in enumerate(live[~go].tolist()):
                out[i] = plain[width * n : width * (n + 1)]
            live, toks, ranks = live[go], toks[go], ranks[go]
            if not len(live):
                break
            rows, at = np.arange(len(live)), np.argmin(ranks, axis=1)
            toks[rows, at] = self.wholes[ranks[rows, at]]
            gone = np.ones(toks.shape, bool)
            gone[rows, at + 1] = False
            toks = toks[gone].reshape(len(live), -1)
            gone = np.ones(ranks.shape, bool)
            gone[rows, at] = False
            ranks = ranks[gone].reshape(len(live), -1)
            for side in (at - 1, at):
                ok = (side >= 0) & (side < ranks.shape[1])
                r, c = rows[ok], side[ok]
                ranks[r, c] = self.rank_of(toks[r, c], toks[r, c + 1])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, the leftmost of equals; n log n for any length."""
        toks = [self.atoms[b] for b in word]
        n, ranks = len(toks), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := ranks.get((toks[i], toks[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if toks[i] != x or j >= n or toks[j] != y:
                continue
            toks[i], toks[j] = ranks[x, y][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((toks[i], toks[k])):
                    heapq.heappush(heap, (r[0], i, toks[i], toks[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((toks[h], toks[i]))):
                heapq.heappush(heap, (r[0], h, toks[h], toks[i]))
        return [t for t in toks if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Speculate and verify over many words at once; words that fail are merged exactly, by length. Ids as 32-bit numbers."""
        if not words:
            return []
        raw = [w.encode("utf-8", "replace") for w in words]
        flat, owner = self.propose(raw)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)
        ends = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
        plain = flat.astype(np.int32).tobytes()
        out = [plain[4 * i : 4 * j] for i, j in zip(ends, ends[1:])]
        failed = defaultdict(list)
        for i in np.unique(owner[inner[~ok[back]]]).tolist():
            failed[len(raw[i])].append(i)
        for size, group in failed.items():
            merged = self.merge_many([raw[i] for i in group]) if size <= LONG_WORD else [np.array(self.merge(raw[i]), np.int32).tobytes() for i in group]
            for i, ids in zip(group, merged):
                out[i] = ids
        return out


class Splitter:
    """Ids of texts, by way of a memory of words; `short` splits texts whose letters all lie below U+0250, `split` any."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.split = vocabulary, regex.compile(PATTERN).findall
        low = {c: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == c) for c in "LN"}
        pattern = PATTERN.replace(r" ?[^\s\p{L}\p{N}]+", f" ?[^{SPACE}{low['L']}{low['N']}]+").replace(r"\p{L}", f"[{low['L']}]").replace(r"\p{N}", f"[{low['N']}]")
        self.short = re.compile(pattern.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.words: dict[str, bytes] = {}

    def encode(self, bodies: list[str]) -> list[np.ndarray]:
        rows = [(self.split if BEYOND(body) else self.short)(body) for body in bodies]
        fresh = set().union(*rows)
        new = list(fresh - self.words.keys())
        if len(self.words) + len(new) > REMEMBERED:
            self.words, new = {}, list(fresh)
        self.words.update(zip(new, self.vocabulary.encode_words(new)))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in rows]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of each whole text (array<int>), as the tokenizers library gives them without added special tokens.

    `tokenizer` is the path of a byte-level BPE file on the driver; its content (megabytes, a fixed size) is broadcast. The
    strings of special tokens in a text become their ids. Null and empty texts give an empty array; repeated rows repeat; a
    column named `out` is replaced, all others stay. A word of any length is merged in n log n steps.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        sent = to_tasks(docs.sparkSession, Vocabulary(f.read()))
    schema = StructType([f for f in docs.schema.fields if f.name != out] + [StructField(out, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = from_driver(sent)
        splitter = Splitter(vocabulary)
        special = regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) or r"(?!)")
        for table in slices(batches, text, PIECE_CHARS):
            pieces, seams = [], []  # texts cut at special strings; of each text, its pieces and the ids between them
            for body in texts(table, text):
                at, ids, n = 0, [], len(pieces)
                for m in special.finditer(body):
                    pieces.append(body[at : m.start()])
                    ids.append(vocabulary.special[m[0]])
                    at = m.end()
                pieces.append(body[at:] if at else body)
                seams.append((n, ids))
            done = splitter.encode(pieces)
            flat = [np.concatenate([done[n], *[x for i, k in enumerate(ids, n + 1) for x in (np.array([k], np.int32), done[i])]]) if ids else done[n] for n, ids in seams]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
            columns = {f.name: table.column(f.name) for f in table.schema} | {out: ids}
            yield from pa.table([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields]).to_batches()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an id array, special tokens included; broken UTF-8 becomes replacement characters.

    Null and empty arrays give empty text; ids outside the vocabulary are skipped, as by the library.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        sent = to_tasks(docs.sparkSession, f.read())
    schema = StructType([f for f in docs.schema.fields if f.name != out] + [StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = json.loads(from_driver(sent))
        letters = byte_letters()
        raw = {i: bytes(map(letters.__getitem__, t)) for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        known = [raw.get(i, b"") for i in range(max(raw) + 1)] + [b""]
        del spec, raw
        last = len(known) - 1
        for batch in batches:
            column = batch.column(ids)
            found = []
            for i in range(batch.num_rows):
                row = column[i].values
                numbers = row.to_numpy(zero_copy_only=False) if row is not None else np.empty(0, np.int64)
                numbers = np.where((numbers < 0) | (numbers > last), last, numbers).tolist()
                found.append(b"".join(map(known.__getitem__, numbers)).decode("utf-8", "replace"))
            columns = {f.name: batch.column(f.name) for f in batch.schema} | {out: pa.array(found, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
