"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

``lookahead`` computes from the merge list how many characters to the right can still change a token: tokens that end
at least so far before the end of what has been read are stable and are emitted, so that memory stays constant for any
length of input. ``Vocabulary.transduce`` runs one such transducer for each new word, many in step; ``Vocabulary.stream`` is
the same for a single word that comes piece by piece. ``Decoder`` is an incremental byte-to-text state machine that feeds on
ids; ``Strings`` is its counterpart under the library's rule for a file without a decoder.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import beside, pieces

SPACE = "\t-\r \x85\xa0  -     　"
SPLIT_SPACE = re.compile(f"[{SPACE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")  # Python's split takes these for white space, the vocabulary's pattern does not


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]]) -> int:
    """A number of characters after which the text to the right no longer changes a token.

    An unseen character reaches left only by a chain of merges of ever later rank: a merge (u, v) whose right part v stands
    at the border of what may differ moves the border left by len(u), and leaves u or uv there. Rules that take the token
    at the border as their left part change it without moving the border. One pass over the rules from the last to the
    first keeps, for each token, the longest way left that later rules allow.
    """
    far: dict[str, int] = {}
    for u, v in reversed(merges):
        joined = far.get(u + v, 0)
        far[v] = max(far.get(v, 0), len(u) + max(joined, far.get(u, 0)))
        far[u] = max(far.get(u, 0), joined)
    return max(far.values(), default=0) + max((len(u + v) for u, v in merges), default=1)


class Vocabulary:
    """A tokenizer file with byte-level BPE and word ends: ids, merge ranks, pattern of words and special strings."""

    BITS, FIB = 20, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str, cache: int = 300_000) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.ahead = lookahead(merges)
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        steps = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else [spec["pre_tokenizer"]]
        self.pattern = compiled(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.cuts = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.most, self.cache, self.known = cache, {}, {}
        self.first = np.array([self.ids[c] for c in self.letters], np.int32)
        self.first_at_end = np.array([self.ids[c + self.suffix] for c in self.letters], np.int32)
        self.product = np.array([self.ids[u + v] for u, v in merges], np.int32)
        self.slot_key, self.slot_rank, self.longest = np.full((1 << self.BITS) + 64, -1), np.zeros((1 << self.BITS) + 64, np.int32), 1
        for k, (u, v) in enumerate(merges):
            key = self.ids[u] << 32 | self.ids[v]
            slot = (key * int(self.FIB) % (1 << 64)) >> (64 - self.BITS)
            for step in range(64):
                if self.slot_key[slot + step] < 0:
                    break
            self.slot_key[slot + step], self.slot_rank[slot + step], self.longest = key, k, max(self.longest, step + 1)
        every = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.letters_of = np.array([len(t.removesuffix(self.suffix)) if self.suffix and t.endswith(self.suffix) else len(t) for t in every], np.int64)
        # what a token stands for: its string with a blank behind, and its bytes with a blank for the word's end
        self.strings = table_of([(t + " ").encode("utf-8", "surrogatepass") for t in every])
        self.plain = table_of([self.bytes_for(t) for t in every])

    def bytes_for(self, token: str) -> bytes:
        if token in self.special:
            return token.encode()
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[: -len(self.suffix)] if end else token
        return bytes(self.bytes_of[c] for c in body if c in self.bytes_of) + b" " * end

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks, top = self.ranks, len(self.ranks)
        if len(symbols) < 2:
            return symbols
        rank = [ranks.get(p, top) for p in zip(symbols, symbols[1:], strict=False)]
        while rank:
            best = min(rank)
            if best == top:
                break
            k = rank.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del rank[k]
            if k:
                rank[k - 1] = ranks.get((symbols[k - 1], symbols[k]), top)
            if k < len(rank):
                rank[k] = ranks.get((symbols[k], symbols[k + 1]), top)
        return symbols

    def bulk(self, words: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (``whole``) or beginnings of words at once and the offsets of each: in every pass each that still has a pair in the list merges its pair of lowest rank, leftmost first."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[raw]
        last = (np.cumsum(size) - 1)[whole]
        symbols[last] = self.first_at_end[raw[last]]
        which = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        top = np.int32(len(self.ranks))
        while len(symbols):
            rank = np.full(len(symbols), top, np.int32)
            inner = np.flatnonzero(which[1:] == which[:-1])
            rank[inner] = self.rank_of(symbols[inner], symbols[inner + 1])
            start = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(symbols)))
            going = np.repeat(low < top, length)
            if not going.all():
                done.append((which[~going], symbols[~going]))
            at = np.flatnonzero(going & (rank == np.repeat(low, length)))
            at = at[np.concatenate([[True], which[at[1:]] != which[at[:-1]]])] if len(at) else at
            symbols[at] = self.product[rank[at]]
            going[at + 1] = False
            symbols, which = symbols[going], which[going]
        which = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(which, kind="stable")
        return symbols[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(words)))])

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or the number of merges: an open-addressing table probed as far as its longest run."""
        key = a.astype(np.int64) << 32 | b
        slot = ((key.astype(np.uint64) * self.FIB) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.full(len(key), len(self.ranks), np.int32)
        for k in range(self.longest):
            at = slot + k
            np.copyto(out, self.slot_rank[at], where=self.slot_key[at] == key)
        return out

    def stream(self, letters: Iterable[str], block: int = 0) -> Iterator[str]:
        """Tokens of one word given piece by piece: each is emitted once it is stable, and no more than about two blocks are held."""
        block = max(block, 1) if block else 4 * self.ahead
        held: list[str] = []
        for piece in letters:
            held += piece
            while len(held) >= self.ahead + block + 1:  # the last letter may yet get the word's end
                # what is emitted ends at a border that stays, so the rest is encoded as if it stood alone
                done, out = 0, []
                for token in self.merged(held[:]):
                    if done + len(token) > len(held) - self.ahead - 1:
                        break
                    out.append(token)
                    done += len(token)
                yield from out
                held = held[done:]
                if not done:
                    block *= 2
        if held:
            held[-1] += self.suffix
            yield from self.merged(held)

    def transduce(self, words: list[bytes], block: int = 0) -> list[bytes]:
        """Ids (little-endian) of each word by a transducer for each, in step: of every word a block is read, what is stable is emitted, and the rest is read again with the next block."""
        block = max(block, 1) if block else 4 * self.ahead
        out: list[list[bytes]] = [[] for _ in words]
        live, begin, reach = list(range(len(words))), [0] * len(words), [block] * len(words)
        while live:
            held = [words[k][begin[k] : begin[k] + self.ahead + reach[k] + 1] for k in live]
            whole = np.array([begin[k] + len(h) == len(words[k]) for k, h in zip(live, held, strict=True)], bool)
            ids, at = self.bulk(held, whole)
            raw, at = ids.astype("<u4").tobytes(), at.tolist()
            on = []
            for j, (k, ends) in enumerate(zip(live, whole.tolist(), strict=True)):
                if ends:
                    out[k].append(raw[4 * at[j] : 4 * at[j + 1]])
                    continue
                done = np.cumsum(self.letters_of[ids[at[j] : at[j + 1]]])
                n = int(np.searchsorted(done, len(held[j]) - self.ahead - 1, "right"))
                if n:
                    out[k].append(raw[4 * at[j] : 4 * (at[j] + n)])
                    begin[k] += int(done[n - 1])
                else:
                    reach[k] *= 2
                on.append(k)
            live = on
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def words(self, chunk: str) -> list[str]:
        """Words of a run without white space."""
        chunk = chunk.lower() if chunk.isascii() else lowered(unicodedata.normalize("NFC", chunk))
        return [chunk] if chunk.isalpha() else self.pattern.findall(chunk)

    def runs(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """Special strings (True) and runs without white space, in order. No word and no normalisation crosses their borders, so tokens are stable there."""
        for k, part in enumerate(self.cuts.split(text) if self.cuts and "<" in text else [text]):
            if k % 2:
                yield True, [part]
            elif ODD_SPACE.search(part):
                yield False, [c for c in SPLIT_SPACE.split(part) if c]
            else:
                yield False, part.split()

    def learn(self, chunks: set[str]) -> None:
        """Put the ids (little-endian) of each new run into the cache."""
        split = {c: [w.encode("utf-8", "surrogatepass") for w in self.words(c)] for c in chunks}
        known = self.known
        fresh = list({w for ws in split.values() for w in ws} - known.keys())
        for a in range(0, len(fresh), 50_000):
            known.update(zip(fresh[a : a + 50_000], self.transduce(fresh[a : a + 50_000]), strict=True))
        for c, ws in split.items():
            self.cache[c] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        if len(self.cache) + len(self.known) > self.most:
            self.cache, self.known = {}, {}
        runs = [list(self.runs(t)) for t in texts]
        seen: set[str] = set()
        for parts in runs:
            for special, chunks in parts:
                if not special:
                    seen.update(chunks)
        self.learn(seen - self.cache.keys())
        cache, out = self.cache, []
        for parts in runs:
            got: list[bytes] = []
            for special, chunks in parts:
                got += [self.special[chunks[0]].to_bytes(4, "little")] if special else [cache[c] for c in chunks]
            out.append(b"".join(got))
        if long := [c for c in seen if len(c) > 256]:
            for c in long:
                del cache[c]
            for w in [w for w in self.known if len(w) > 256]:
                del self.known[w]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: the tokens' strings with a blank between."""
        machine = Strings(self)
        return (machine.feed(np.fromiter((i for i in ids if i in self.tokens), np.int64)) + machine.end()).decode("utf-8", "surrogatepass")


def table_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all parts, where each begins, and its length."""
    size = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def spelt(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The parts of a table that ids name, one behind the other."""
    data, begin, size = table
    n = size[ids]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return b""
    return data[np.arange(ends[-1]) + np.repeat(begin[ids] - (ends - n), n)].tobytes()


class Strings:
    """Incremental decoder under the library's rule for a file without a decoder: the tokens' strings with a blank between, in UTF-8."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table, self.begun = vocabulary.strings, False

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids; the blank behind the last one waits for the next."""
        if not len(ids):
            return b""
        out = (b" " if self.begun else b"") + spelt(ids, self.table)[:-1]
        self.begun = True
        return out

    def end(self) -> bytes:
        return b""


class Decoder:
    """Incremental byte-to-text machine: feeds on ids, gives text as soon as whole characters stand; broken bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table, self.utf8 = vocabulary.plain, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: int | np.ndarray) -> str:
        return self.utf8.decode(spelt(np.atleast_1d(np.asarray(ids, np.int64)), self.table))

    def end(self) -> str:
        return self.utf8.decode(b"", True)


#: Ids that a decoder takes at once.
STEP = 1 << 16


def decoded_hashes(raw: bytes, v: Vocabulary) -> tuple[str, str]:
    """SHA-256 of what the library's rule and the byte-to-text machine make of ids, fed in steps."""
    strings, text = Strings(v), Decoder(v)
    a, b = hashlib.sha256(), hashlib.sha256()
    ids = np.frombuffer(raw, "<u4")
    for k in range(0, len(ids), STEP):
        part = ids[k : k + STEP].astype(np.int64)
        a.update(strings.feed(part))
        b.update(text.feed(part).encode())
    b.update(text.end().encode())
    return a.hexdigest(), b.hexdigest()


@lru_cache(maxsize=1)
def letter_classes() -> dict[str, str]:
    r"""Ranges of \p{L} and \p{N} from the interpreter's Unicode tables, as the inside of a character class."""
    out: dict[str, list[str]] = {"L": [], "N": []}
    start, kind = 0, ""
    for c in range(sys.maxunicode + 2):
        now = unicodedata.category(chr(c))[0] if c <= sys.maxunicode else ""
        if now != kind:
            if kind in out:
                out[kind].append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start, kind = c, now
    return {k: "".join(v) for k, v in out.items()}


def compiled(pattern: str) -> re.Pattern[str]:
    r"""A vocabulary's pattern with \p{L}, \p{N} and \s, all within classes, spelt out."""
    for name, inside in (*((f"\\p{{{k}}}", v) for k, v in letter_classes().items()), ("\\s", SPACE)):
        pattern = pattern.replace(name, inside)
    return re.compile(pattern)


def lowered(text: str) -> str:
    """Lower case letter by letter, without the rule for a sigma that ends a word."""
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 and plain_sha256 of every row; with ``ids`` also the array token_ids.

    decoded_sha256 is of the ids decoded by the library's rule, plain_sha256 of the text that the byte-to-text machine gives
    back: the words as encoded (lower case, NFC), a blank behind each. Null and empty texts have no tokens (hashes of
    nothing). Rows are independent, so ties, repeated rows and empty tables need no care, and columns of ``df`` that are not
    in ``keep`` are not read. ``path`` must exist on every executor.
    """
    path = path or default_path()

    def found(values: pa.Array) -> pa.RecordBatch:
        v = vocabulary(path)
        n, a, b, c, d = [], [], [], [], []
        for x, y in pieces(values):
            for raw in v.encode_batch([t or "" for t in values.slice(x, y - x).to_pylist()]):
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                strings, plain = decoded_hashes(raw, v)
                b.append(strings)
                c.append(plain)
                if ids:
                    d.append(np.frombuffer(raw, "<u4").astype(np.int32))
        cols = [pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (a, b, c)), *([pa.array(d, pa.list_(pa.int32()))] if ids else [])]
        return pa.RecordBatch.from_arrays(cols, ["n_tokens", "ids_sha256", "decoded_sha256", "plain_sha256", *(["token_ids"] if ids else [])])

    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string, plain_sha256 string" + ", token_ids array<int>" * ids
    return df.select(*keep, beside(df, text, found, kinds).alias("__found")).select(*keep, "__found.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of documents, encoded and decoded again."""
    from .common import table

    return encode(table(spark, sf_dir, "documents"))
