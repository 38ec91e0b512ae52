"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each word has a tree whose leaves are the ranks of its adjacent pairs; a node holds the smaller of its children, and
ties go to the left, so the root is the leftmost lowest-rank merge. A merge changes at most three leaves, each
renewed along one path to the root. Trees of one width are worked on together in numpy: every step takes the next
merge of all words that have one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.tables import give_back, of_worker, others, schema_of, small_batches

NONE = np.int64(1) << 62
#: Bits of a leaf that say where its pair is; a word of 2**40 bytes fits in no machine.
PLACE = 40
#: Words whose ids are kept at most, in each worker; beyond it they are forgotten and encoded anew.
WORDS = 100_000
#: White space as the file's patterns mean it.
BLANK = r"[\t-\r \x85\xa0  -     　]"


#: Upper-case letters newer than Unicode 15.1, which Python 3.13 has, that the library changes to lower case, as first, last and distance.
NEWER_UPPER = (
    (0x1C89, 0x1C89, 1),
    (0xA7CB, 0xA7CB, -42343),
    (0xA7CC, 0xA7CC, 1),
    (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1),
    (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1),
    (0xA7DC, 0xA7DC, -42561),
    (0x10D50, 0x10D65, 32),
    (0x16EA0, 0x16EB8, 27),
)


#: Letters and numbers newer than Unicode 16, first and last. The library's patterns are of that version
#: and take them for other characters.
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


#: Marks, first and last, that the library's NFC is too old to know: it puts none of them in another order.
NEWER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C),
    (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42),
    (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes as the tokenizers library does with a file of this kind: NFC, blanks, lower case; split; byte letters; BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.inner = np.array([vocab.get(x, -1) for x in letters], np.int64)
        self.final = np.array([vocab.get(x + suffix, -1) for x in letters], np.int64)
        pair = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        names = {i: t for t, i in (vocab | added).items()}
        self.name = [names.get(i, "").encode() for i in range(max(names) + 1)]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", "[^" + BLANK[1:-1])
        self.find = regex.compile(pattern).findall
        self.lower_newer = {c: c + by for first, last, by in NEWER_UPPER for c in range(first, last + 1)}
        newer = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER_LETTERS)
        self.has_newer = regex.compile(f"[{newer}{''.join(map(chr, self.lower_newer))}]").search
        # The same pattern with letters and numbers cut to those of Unicode 16.
        others = pattern[pattern.index("[^") :]
        narrow = pattern.replace(others, f"(?:{others[:-1]}|[{newer}])+").replace(r"|[\p{L}]", rf"|[\p{{L}}--[{newer}]]").replace(r"|[\p{N}]", rf"|[\p{{N}}--[{newer}]]")
        self.find_narrow = regex.compile(narrow, regex.V1).findall
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split if added else lambda t: [t]
        self.blanks = regex.compile(BLANK + "+").sub
        marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER_MARKS)
        self.between_marks = regex.compile(f"([{marks}]+)").split
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = _Numbered()
        self.ids: list[bytes] = []
        self.text: list[bytes] = []
        self.n: list[int] = []

    def words(self, text: str) -> list[str]:
        """What the text is split into before BPE; special tokens' own strings stand for themselves."""
        out = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                part = part if part.isascii() else "".join(x if j % 2 else unicodedata.normalize("NFC", x) for j, x in enumerate(self.between_marks(part)))
                part = self.blanks(" ", part).replace("Σ", "σ").lower()
                if part.isascii() or not self.has_newer(part):
                    out += self.find(part)
                else:
                    out += self.find_narrow(part.translate(self.lower_newer))
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[i] == key) & (a >= 0) & (b >= 0), self.rank[i], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; words is a batch of byte strings with at most as many pairs as the widest needs."""
        size = np.array([len(w) for w in words])
        width = 1 << int(max(1, size.max() - 1) - 1).bit_length()
        n, rows = len(words), np.arange(len(words))
        sym = np.full((n, width + 2), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(rows, size)
        sym[row, col] = self.inner[flat]
        sym[rows, size - 1] = self.final[flat[np.cumsum(size) - 1]]
        after = np.tile(np.arange(1, width + 3), (n, 1))
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        leaves = self.ranks(sym[:, :width], sym[:, 1 : width + 1])
        tree[:, width:] = np.where(leaves < NONE, (leaves << PLACE) | np.arange(width), NONE)
        for k in range(width.bit_length() - 2, -1, -1):
            level = tree[:, 1 << k + 1 : 2 << k + 1]
            tree[:, 1 << k : 2 << k] = np.minimum(level[:, 0::2], level[:, 1::2])

        def renew(r, at, value):
            node = at + width
            tree[r, node] = value
            while node.size and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = rows[tree[:, 1] < NONE]
        while len(live):
            root = tree[live, 1]
            left = root & ((1 << PLACE) - 1)
            right = after[live, left]
            sym[live, left] = self.made[root >> PLACE]
            sym[live, right] = -2
            beyond = after[live, right]
            after[live, left] = beyond
            inside = beyond <= width
            before[live[inside], beyond[inside]] = left[inside]
            has = right < width
            renew(live[has], right[has], NONE)
            rank = np.where(inside, self.ranks(sym[live, left], sym[live, np.minimum(beyond, width)]), NONE)
            renew(live, left, np.where(rank < NONE, (rank << PLACE) | left, NONE))
            prior = before[live, left]
            has = prior >= 0
            r, p = live[has], prior[has]
            rank = self.ranks(sym[r, p], sym[r, left[has]])
            renew(r, p, np.where(rank < NONE, (rank << PLACE) | p, NONE))
            live = live[tree[live, 1] < NONE]
        kept = sym >= 0
        cut = np.cumsum(kept.sum(axis=1))
        return np.split(sym[kept], cut[:-1])

    def learn(self, words: list[str]) -> None:
        """Ids and decoded text of new words, in batches of like width."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, (w, b) in enumerate(zip(words, raw, strict=True)):
            if w in self.special:
                out[i] = np.array([self.special[w]])
            else:
                by_width.setdefault((len(b) - 1).bit_length(), []).append(i)
        for bits, which in by_width.items():
            step = max(1, (1 << 18) >> bits)
            for a in range(0, len(which), step):
                part = which[a : a + step]
                for i, ids in zip(part, self.merge([raw[i] for i in part]), strict=True):
                    out[i] = ids
        for ids in out:
            self.ids.append(ids.astype("<u4").tobytes())
            self.text.append(b" ".join([self.name[i] for i in ids.tolist()]))
            self.n.append(len(ids))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes, int]]:
        """Ids as little-endian unsigned 32-bit integers, their decoded text in UTF-8, and how many they are."""
        if len(self.at) > WORDS:
            self.forget()
        docs = [list(map(self.at.__getitem__, self.words(t or ""))) for t in texts]
        self.learn(list(self.at)[len(self.ids) :])
        for w in docs:
            if not w:
                yield b"", b"", 0
                continue
            pick = itemgetter(*w) if len(w) > 1 else lambda x, i=w[0]: (x[i],)
            text = pick(self.text)
            yield b"".join(pick(self.ids)), b" ".join(text if all(text) else [t for t in text if t]), sum(pick(self.n))


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encoder(path: str) -> Encoder:
    return of_worker("encoder", path, lambda: Encoder(path))


def bpe(documents: DataFrame, path: str) -> DataFrame:
    """documents with n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (string: tokens joined by one blank).

    path: a vocabulary file of the tokenizers library (BPE with word ends) that every executor has. Whole texts are
    encoded; null is as the empty text: no ids, empty decoded. Rows are independent, so repeated rows, null ids and
    other columns are kept as they are; those named like a result, in whatever case, are replaced. An empty table gives
    an empty result.
    """
    small_batches(documents.sparkSession)
    kept = others(documents, "n_tokens", "ids", "decoded")
    docs = documents.select([F.col(f"`{c}`") for c in kept]).withColumn("text", F.col("text").cast("string"))
    schema = schema_of(docs, docs.columns) + ", n_tokens long, ids binary, decoded string"

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            at = 0
            while at < b.num_rows:
                n, size = 0, 0
                part = []
                while at + n < b.num_rows and size < 1 << 20:
                    part.append(texts[at + n].as_py())
                    size += len(part[-1] or "")
                    n += 1
                ids, text, count = zip(*e.encode(part), strict=True)
                cols = [c.slice(at, n) for c in b.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.binary()).cast(pa.string())], names=[*b.schema.names, "n_tokens", "ids", "decoded"])
                at += n
        give_back()

    return docs.mapInArrow(run, schema)
