"""Operator 10: BPE encoding and decoding by tree concatenation.

A text of more than ``TREE_BYTES`` is encoded as a tree: it is halved until its
parts are no longer, all parts of a batch are encoded together, and neighbours
are joined by re-encoding a growing window around the join until its tokens
agree exactly with those of both sides. Two valid encodings that share tokens
over the same characters can be spliced there, since a BPE result is valid
exactly when all its adjacent pairs are. Of a part only the ends are encoded
with the place of every token, as joins look there; a join whose window would
leave them encodes its text again as a tree of parts with all places.

Shorter texts, and the middles of parts, are cut at ASCII white space where the
tokenizer drops white space itself (its pre-tokenizer never joins characters
across it), and each distinct piece is encoded once per worker; a piece of over
``LEAF_CHARS`` characters without white space is a tree again.

Defined results: null and empty texts have no tokens and decode to the empty
text; repeated rows give repeated results; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm.common import bounded, doc_bytes, table

#: Pieces that a worker remembers, and their longest; past that it starts anew, so memory is bounded.
CACHE_PIECES, CACHED_PIECE = 700_000, 256
#: Bytes of a text, and of a part of it, that need no halving, and characters of a part's ends.
TREE_BYTES, EDGE_CHARS = 8192, 160
#: ASCII symbols without the apostrophe, and the UTF-8 bytes of a-z and Latin-1 letters: the tokenizer
#: always splits a piece of such letters from the symbols after them.
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
LATIN = bytes([*range(97, 123), *range(0x80, 0xC0), 0xC3])
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Characters of a piece that is still encoded by one library call.
LEAF_CHARS = 2048
#: First half-width, in characters, of the window around a join.
WINDOW_CHARS = 32


class PieceEncoder:
    """Encodes whole texts to packed little-endian ids, exactly as the library does."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, leaf: int = LEAF_CHARS, tree: int = TREE_BYTES):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        conf = json.loads(self.tk.to_str())
        self.vocab = self.tk.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self.width = int(self.dtype[-1])
        self.cache: dict[bytes, bytes] = {}
        self.cache_pieces, self.leaf, self.tree = cache_pieces, leaf, tree
        self.joins = 0
        added = [t["content"] for t in conf["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.by_piece = self._drops_space(conf) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf["added_tokens"])
        self.suffix = conf["model"].get("end_of_word_suffix")
        self.plain_decode = conf["decoder"] is None
        steps = [x.get("type") for x in (conf["normalizer"] or {}).get("normalizers", [])]
        self.words: dict[bytes, bytes] | None = {} if self.by_piece and self.suffix and {"NFC", "Lowercase"} <= set(steps) and not any(re.fullmatch(r"[a-z]+\W*", t) for t in added) else None
        self.strings = [self.tk.id_to_token(i) for i in range(self.vocab)]
        self.ends = None

    @staticmethod
    def _drops_space(conf: dict) -> bool:
        """True if ASCII white space only ever separates: it is squeezed, then dropped by the first split."""
        steps = (conf["normalizer"] or {}).get("normalizers", [])
        split = (conf["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        squeezed = any(s.get("type") == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " " for s in steps)
        return bool(squeezed and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and r"[^\s" in split["pattern"].get("Regex", "") and all(s["type"] in ("NFC", "Lowercase", "Replace") for s in steps))

    def pack(self, ids) -> bytes:
        import numpy as np

        return np.asarray(ids, dtype=self.dtype).tobytes()

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text; long texts as trees."""
        long = [k for k, t in enumerate(texts) if len(t) > self.tree]
        out = self._encode_pieces([b"" if len(t) > self.tree else t for t in texts])
        for k, ids in zip(long, self.encode_trees([texts[k].decode("utf-8", "replace") for k in long])):
            out[k] = ids
        return out

    def _encode_pieces(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text, piece by piece."""
        if not self.by_piece:
            return [self.pack(e.ids) for e in self.tk.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        if len(self.cache) > self.cache_pieces:
            self.cache = {}
        if self.words is not None:
            # Marks that compose with ASCII letters have these lead bytes; without them A-Z can be lowered first.
            texts = [t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower() for t in texts]
        split = [t.split() for t in texts]
        new = set().union(*split).difference(self.cache)
        passing = self._learn(list(new)) if new else ()
        packed = self.cache.__getitem__
        out = [b"".join(map(packed, words)) for words in split]
        for p in passing:  # long pieces are not remembered
            del self.cache[p]
        return out

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """Encode pieces that are new to this worker; returns those too long to be remembered."""
        passing = [p for p in pieces if len(p) > CACHED_PIECE]
        if self.words is not None:
            pieces = self._learn_simple(pieces)
        short, long = [], []
        for p in pieces:
            (long if len(p) > self.leaf else short).append(p)
        pack, cache = self.pack, self.cache
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            for p, e in zip(part, self.tk.encode_batch_fast([p.decode("utf-8", "replace") for p in part], add_special_tokens=False)):
                cache[p] = pack(e.ids)
        for p in long:
            cache[p] = pack(self.encode_long(p.decode("utf-8", "replace")))
        return passing

    def _learn_simple(self, pieces: list[bytes]) -> list[bytes]:
        """Learn pieces of letters and symbols by their two parts; the others are returned.

        New letter parts go to the library many at a time, separated by spaces;
        the word-end mark of their last tokens tells them apart again.
        """
        import numpy as np

        if len(self.words) > self.cache_pieces:
            self.words = {}
        words, rest, simple = self.words, [], []
        for p in pieces:
            w = p.rstrip(SYMBOLS)
            if w and len(p) <= CACHED_PIECE and (w.isalpha() or not w.translate(None, LATIN) and b"\xc3\x97" not in w and b"\xc3\xb7" not in w) and w == w.lower():
                simple.append((p, w, p[len(w) :]))
            else:
                rest.append(p)
        if self.ends is None:
            self.ends = np.array([bool(t) and t.endswith(self.suffix) for t in self.strings])
        new = list(dict.fromkeys(w for _, w, _ in simple if w not in words))
        for i in range(0, len(new), 100):
            part = new[i : i + 100]
            ids = np.array(self.tk.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # these words cannot be told apart: one by one
                for w, e in zip(part, self.tk.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                    words[w] = self.pack(e.ids)
                continue
            data, at = ids.tobytes(), 0
            for w, stop in zip(part, (stops * self.width).tolist()):
                words[w] = data[at:stop]
                at = stop
        symbols = list({s for _, _, s in simple if s and s not in words})
        for s, e in zip(symbols, self.tk.encode_batch_fast([s.decode() for s in symbols], add_special_tokens=False)):
            words[s] = self.pack(e.ids)
        for p, w, s in simple:
            self.cache[p] = words[w] + words[s] if s else words[w]
        return rest

    def encode_trees(self, texts: list[str]) -> list[bytes]:
        """Packed ids of long texts: parts of all of them are encoded together, then joined text by text."""
        plans, middles, edges = [], [], []
        for text in texts:
            plan = []
            for part in self.special.split(text) if self.special else [text]:
                if part and self.special and self.special.fullmatch(part):
                    plan.append(self.pack([self.tk.token_to_id(part)]))
                elif part:
                    plan.append((part, [self._part(part, lo, hi, middles, edges) for lo, hi in self._halves(part, self.tree)]))
            plans.append(plan)
        packed = self._encode_pieces([m.encode("utf-8", "replace") for m in middles])
        placed = self.tk.encode_batch([text[a:b] for text, a, b in edges], add_special_tokens=False)
        tokens = [[(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets)] for e, (_, at, _) in zip(placed, edges)]
        return [b"".join(p if isinstance(p, bytes) else self._joined(*p, packed, tokens) for p in plan) for plan in plans]

    def _part(self, text: str, lo: int, hi: int, middles: list, edges: list) -> tuple:
        """(lo, hi, head, middle, tail) of a part: numbers of its pieces in the lists; without a middle the head is all of it."""
        a = b = None
        if self.by_piece and hi - lo > 4 * EDGE_CHARS:
            a, b = SPACE.search(text, lo + EDGE_CHARS, hi), max(text.rfind(c, lo, hi - EDGE_CHARS) for c in " \n\t\r\x0b\x0c")
        if not a or b <= a.start():
            edges.append((text, lo, hi))
            return lo, hi, len(edges) - 1, None, None
        a = a.start()
        edges += [(text, lo, a), (text, b, hi)]
        middles.append(text[a:b])
        return lo, hi, len(edges) - 2, len(middles) - 1, len(edges) - 1

    def _joined(self, text: str, parts: list, packed: list, tokens: list) -> bytes:
        """Splice neighbours, each at the ends that meet; the tree's order does not matter, as joins do not overlap."""
        out, open_tokens, lo = [], tokens[parts[0][2]], parts[0][0]
        for k, (start, _, head, middle, tail) in enumerate(parts):
            if k:
                right_end = self._edge_end(text, parts[k])
                joined = self._splice(text, open_tokens, tokens[head], start, lo, right_end, (lo == 0, right_end == len(text)))
                if joined is None:
                    return self.pack(self._tree(text))
                open_tokens = joined
            if middle is not None:
                out += [self.pack([t[0] for t in open_tokens]), packed[middle]]
                open_tokens, lo = tokens[tail], self._edge_start(text, parts[k])
        return b"".join([*out, self.pack([t[0] for t in open_tokens])])

    @staticmethod
    def _edge_end(text: str, part: tuple) -> int:
        """Where the head of a part ends."""
        lo, hi, _, middle, _ = part
        return hi if middle is None else SPACE.search(text, lo + EDGE_CHARS, hi).start()

    @staticmethod
    def _edge_start(text: str, part: tuple) -> int:
        """Where the tail of a part begins."""
        lo, hi, _, _, _ = part
        return max(text.rfind(c, lo, hi - EDGE_CHARS) for c in " \n\t\r\x0b\x0c")

    def encode_long(self, text: str) -> list[int]:
        """Ids of a long unsplit text, by tree concatenation between special tokens."""
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part and self.special and self.special.fullmatch(part):
                out.append(self.tk.token_to_id(part))
            elif part:
                out += self._tree(part)
        return out

    def _encoded(self, text: str, at: int) -> list[tuple[int, int, int]]:
        e = self.tk.encode(text, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets)]

    def _halves(self, text: str, leaf: int) -> list[tuple[int, int]]:
        """Bounds of the parts of a text, halved at safe places until they are no longer than ``leaf``."""
        out, todo = [], [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            mid = safe_cut(text, (lo + hi) // 2, lo, hi) if hi - lo > leaf else None
            if mid is None:
                out.append((lo, hi))
            else:
                todo += [(mid, hi), (lo, mid)]
        return out

    def _tree(self, text: str) -> list[int]:
        """Ids of a text from parts that are encoded with the places of all tokens."""
        bounds = self._halves(text, self.leaf)
        parts = [(lo, hi, [(i, a + lo, b + lo) for i, (a, b) in zip(e.ids, e.offsets)]) for (lo, hi), e in zip(bounds, self.tk.encode_batch([text[a:b] for a, b in bounds], add_special_tokens=False))]
        while len(parts) > 1:  # neighbours join in pairs
            joined = [(a, d, self._splice(text, left, right, b, a, d, (True, True))) for (a, b, left), (_, d, right) in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(parts) // 2 * 2 :]
        return [i for i, _, _ in parts[0][2]]

    def _splice(self, text: str, left: list, right: list, mid: int, lo: int, hi: int, whole: tuple[bool, bool]) -> list | None:
        """Tokens of text[lo:hi] from those of its two sides.

        ``whole`` says of each end whether the window may end there without
        agreeing first: the sides' tokens count as right up to there. None if the
        window has reached an end that is not so, without agreement.
        """
        self.joins += 1
        half = WINDOW_CHARS
        while True:
            a = (safe_cut(text, mid - half, lo, mid) or lo) if mid - half > lo else lo
            b = (safe_cut(text, mid + half, mid, hi) or hi) if mid + half < hi else hi
            window = self._encoded(text[a:b], a)
            head = (0, 0) if a == lo and whole[0] else shared(left, window, lambda t: t[2] <= mid)
            tail = (len(right), len(window)) if b == hi and whole[1] else shared(right, window, lambda t: t[1] >= mid)
            if head and tail and head[1] <= tail[1]:
                return left[: head[0]] + window[head[1] : tail[1]] + right[tail[0] :]
            if a == lo and b == hi:
                return None
            half *= 2

    def decode(self, ids) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        if self.plain_decode:
            return " ".join([s for s in map(self.strings.__getitem__, ids) if s is not None])
        return self.tk.decode(list(ids), skip_special_tokens=False)


def safe_cut(text: str, near: int, lo: int, hi: int, reach: int = 64) -> int | None:
    """A position in (lo, hi) near ``near`` where halves normalize and split as the whole does.

    The next character must be one that never composes with what stands before
    it, and no apostrophe may be so near that a contraction could be cut.
    """
    for d in range(reach):
        for p in (near - d, near + d):
            if lo < p < hi and "'" not in text[max(0, p - 4) : p + 4]:
                c = text[p]
                if c.isascii() or unicodedata.category(c)[0] in "LNPS" and not 0x1100 <= ord(c) <= 0x11FF and unicodedata.is_normalized("NFC", text[p - 1 : p + 1]) and not unicodedata.decomposition(c):
                    return p
    return None


def shared(side: list, window: list, usable) -> tuple[int, int] | None:
    """Indices of a token that both sequences hold over the same characters, with its follower alike."""

    def clear(seq: list, i: int) -> bool:
        return (i == 0 or seq[i - 1][2] <= seq[i][1]) and (i + 1 == len(seq) or seq[i + 1][1] >= seq[i][2]) and seq[i][1] < seq[i][2]

    first = {t: i for i, t in enumerate(side) if usable(t)}
    for j in range(len(window) - 1):
        i = first.get(window[j])
        if i is not None and usable(window[j + 1]) and i + 1 < len(side) and side[i + 1] == window[j + 1] and clear(side, i) and clear(window, j) and clear(side, i + 1) and clear(window, j + 1):
            return i + 1, j + 1
    return None


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary file and worker process."""
    return PieceEncoder(path)


def encode_documents(docs: DataFrame, tokenizer: str, decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (packed), and the decoded text of every document."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc = encoder(tokenizer)
        for b in bounded(batches):
            packed = enc.encode_many(b.column("text").to_pylist())
            ids = [np.frombuffer(p, dtype=enc.dtype) for p in packed]
            cols = [b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if decode:
                cols.append(pa.array([enc.decode(i.tolist()) for i in ids], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decode)


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the encoder's outputs as digests, made where the ids are."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc, sha = encoder(tokenizer), hashlib.sha256
        for b in bounded(batches):
            n, ids_sha, text_sha = [], [], []
            for p in enc.encode_many(b.column("text").to_pylist()):
                ids = np.frombuffer(p, dtype=enc.dtype)
                n.append(len(ids))
                ids_sha.append(sha(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(sha(enc.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
