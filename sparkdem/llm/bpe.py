"""Byte-level BPE with a lexicon of frequent words in a minimal acyclic transducer.

Words (pretokens) are counted over the whole corpus on Spark. The most frequent ones are compiled, with their ids, into
an automaton that shares prefixes and suffixes; arcs carry numbers whose sum along a word's path is the word's place in
the table of ids. The automaton is a flat file that Spark ships to every executor once and whose workers map it into
memory. Words that it doesn't hold are merged exactly, so the ids never depend on what is in the lexicon.
"""

from __future__ import annotations

import functools
import hashlib
import json
import mmap
import os
import re
import tempfile
import uuid
from collections import Counter

import numpy as np
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from sparkdem.llm.common import arrow_map, materialise

#: Fixed value: the pretoken pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts in ASCII and the letters of Latin-1 alone, where explicit classes say the same and run faster.
PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Words in the lexicon at most, and characters that are encoded at a time: bounds of memory, without effect on results.
LEXICON_WORDS, CHARS_AT_A_TIME, WORDS_COUNTED_AT_A_TIME = 65_536, 1_000_000, 150_000
#: Longer words are merged, never listed, so the lexicon is bounded in bytes, too.
WORD_BYTES = 64


@functools.lru_cache(maxsize=1)
def newer_characters() -> tuple[np.ndarray, regex.Pattern]:
    """(whether each code point is one that the regex module takes for a letter or number and the tokenizers library, of an older
    Unicode, doesn't; the pretoken pattern without them). The library is asked: a letter stays with one before it."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    split, other = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str, []
    for kind, before in ((r"\p{L}+", "a"), (r"\p{N}+", "1")):
        for run in regex.findall(kind, every):
            if len(split(before + run)) > 1:  # not all of them are
                together = {at[0] for _, at in split("\n".join(before + c for c in run)) if at[1] - at[0] == 2}
                other += [c for k, c in enumerate(run) if 3 * k not in together]
    codes = np.array(sorted(map(ord, other)), np.int64)
    ends = np.flatnonzero(np.diff(codes, append=1 << 30) > 1)
    ranges = zip(codes[np.concatenate([[0], ends[:-1] + 1])], codes[ends]) if len(codes) else ()
    some = "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges) + "]" if len(codes) else "(?!)"
    pattern = PATTERN.replace(r"\p{L}+|", rf"(?:(?!{some})\p{{L}})+|").replace(r"\p{N}+|", rf"(?:(?!{some})\p{{N}})+|").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|{some})+")
    table = np.zeros(0x110000, bool)
    table[codes] = True
    return table, regex.compile(pattern)


class Vocabulary:
    """Tokens of a byte-level BPE file in the tokenizers library's JSON format.

    Merges are done by rank of the merged token, which is the order of the file's merges if ids rise with them, and words
    are split by PATTERN; a file of which either doesn't hold is refused. Letters and numbers are those of the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path}: its merges aren't in the order of ids, or it doesn't split words by the byte-level pattern")
        plain = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = [b""] * (max([*plain.values(), *self.special.values()]) + 1)
        for t, i in [*plain.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = t
        self.merger = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.texts_of = list(map(str, range(len(self.bytes_of))))

    def words(self, text: str) -> list[str]:
        """Pretokens, in order; a special token's string is one of its own."""
        if any(t in text for t in self.special) and (parts := self.splitter.split(text))[1:]:
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return QUICK.findall(text)
        newer, older_pattern = newer_characters()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return (older_pattern if newer[codes].any() else self.pattern).findall(text)

    def merge(self, word: str) -> list[int]:
        """Ids of one pretoken, by exact merges."""
        i = self.special.get(word)
        return self.merger._encode_single_piece(word) if i is None else [i]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words as a flat file.

    Parts: a header of five counts; arcs sorted by state * 256 + byte, with target and number; a final flag by state;
    where each word's ids start; the ids, all in the words' byte order. Words are added in that order and states that
    have no more words to come are merged with an equal one, so the automaton is minimal throughout.
    """
    order = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    counts: list[int] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return register[key]

    path: list[list] = [[0, [], 0]]  # final, settled arcs, byte that leads here
    last = b""
    for w in order:
        shared = len(os.path.commonprefix([last, w]))
        while len(path) > shared + 1:
            done = path.pop()
            path[-1][1].append((done[2], settle(done)))
        path += [[0, [], b] for b in w[shared:]]
        path[-1][0] = 1
        last = w
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((done[2], settle(done)))
    root = settle(path[0])
    arcs = []
    for s, (final, out) in enumerate(states):
        before = final
        for b, t in out:
            arcs.append((s * 256 + b, t, before))
            before += counts[t]
    table = np.array(sorted(arcs), np.int64).reshape(-1, 3)
    starts = np.cumsum([0, *(len(words[w]) for w in order)])
    ids = np.array([i for w in order for i in words[w]], np.int64)
    final = np.array([f for f, _ in states], np.int64)
    head = np.array([len(table), len(states), len(order), len(ids), root], np.int64)
    return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (head, *table.T, final, starts, ids))


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        arcs, states, words, ids, self.root = map(int, data[:5])
        cuts = np.cumsum([5, arcs, arcs, arcs, states, words + 1, ids])
        self.keys, self.targets, self.numbers, self.final, self.starts, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:]))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, or -1: all words walk the automaton side by side, a byte at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.cumsum(sizes) - sizes
        place, out = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        live, state, step = np.arange(len(words)), np.full(len(words), self.root, np.int64), 0
        while len(live) and len(self.keys):
            ends = sizes[live] == step
            done = live[ends & (self.final[state] == 1)]
            out[done] = place[done]
            live, state = live[~ends], state[~ends]
            key = state * 256 + data[at[live] + step]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[spot] == key
            live, spot = live[go], spot[go]
            place[live] += self.numbers[spot]
            state, step = self.targets[spot], step + 1
        return out


@functools.lru_cache(maxsize=2)
def lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def encode_texts(texts: list[str], vocab: Vocabulary, lex: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text)."""
    known: dict[str, int] = {}
    codes: list[int] = []
    n_words = []
    for t in texts:
        words = vocab.words(t)
        n_words.append(len(words))
        codes += [known.setdefault(w, len(known)) for w in words]
    distinct = list(known)
    places = lex.find([w.encode("utf-8", "surrogatepass") for w in distinct]) if lex else np.full(len(distinct), -1)
    missing = np.flatnonzero(places < 0)
    merged = [vocab.merge(distinct[i]) for i in missing.tolist()]
    sizes, starts = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    pool = np.array([i for ids in merged for i in ids], np.int32)
    sizes[missing] = np.fromiter(map(len, merged), np.int64, len(merged))
    starts[missing] = np.cumsum(sizes[missing]) - sizes[missing]
    if lex:
        hit = np.flatnonzero(places >= 0)
        sizes[hit] = lex.starts[places[hit] + 1] - lex.starts[places[hit]]
        starts[hit] = lex.starts[places[hit]] + len(pool)
        pool = np.concatenate([pool, lex.ids.astype(np.int32)])
    code = np.array(codes, np.int64)
    each = sizes[code]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    ids = pool[np.repeat(starts[code] - (ends - each), each) + np.arange(total)]
    word_ends = np.cumsum(n_words, dtype=np.int64)
    upto = np.concatenate([[0], ends])[np.concatenate([[0], word_ends])]
    return ids, np.diff(upto)


def batches_of_texts(batch, column: int = 1):
    """(first row, texts) so that a group has few characters unless it is one text; nulls become empty texts."""
    group, chars, first = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py() or ""
        if group and chars + len(t) > CHARS_AT_A_TIME:
            yield first, group
            group, chars, first = [], 0, i
        group.append(t)
        chars += len(t)
    if group:
        yield first, group


def count_words(df: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """word, n: how often each pretoken occurs in all texts. Counts are summed in each task before they are shuffled."""

    def run(batches):
        vocab, seen = vocabulary(vocab_path), Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(vocab.words(t.as_py() or ""))
                if len(seen) > WORDS_COUNTED_AT_A_TIME:
                    yield list(seen), list(seen.values())
                    seen.clear()
        yield list(seen), list(seen.values())

    found = arrow_map(df.select(F.col(text_col).cast("string").alias("text")), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, vocab_path: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of all texts; gives the name under which every executor has the file.

    Frequencies are taken in classes of two significant digits: the lexicon holds the highest classes that have `size`
    words at most together, so the driver gets no more than that, whatever the corpus and the number of tasks. Words
    that occur once aren't worth an entry. A lexicon of no words is valid.
    """
    scale = F.pow(F.lit(10), F.greatest(F.lit(0), F.length(F.col("n").cast("string")) - 2)).cast("long")
    counts = materialise(count_words(df, vocab_path, text_col).where(f"n > 1 and octet_length(word) <= {WORD_BYTES}").withColumn("level", F.expr("n div 1") - F.col("n") % scale), "words")
    least, held = None, 0
    for level, words in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 90 classes a digit
        if held + words > size:
            break
        least, held = level, held + words
    top = counts.where(F.col("level") >= least).select("word").collect() if held else []
    vocab = vocabulary(vocab_path)
    data = compile_lexicon({r.word.encode("utf-8", "surrogatepass"): vocab.merge(r.word) for r in top})
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"{uuid.uuid4().hex}.lex")
    with open(path, "wb") as f:
        f.write(data)
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(df: DataFrame, vocab_path: str, lexicon_name: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>) of every row, repeated rows included. A null or empty text has no ids; texts of any length
    are encoded whole. Strings of special tokens in a text become those tokens."""

    def run(batches):
        vocab, lex = vocabulary(vocab_path), lexicon(lexicon_name) if lexicon_name else None
        import pyarrow as pa

        for batch in batches:
            for first, texts in batches_of_texts(batch):
                ids, sizes = encode_texts(texts, vocab, lex)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, ids array<int>")


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """id, ids_sha256, n_tokens and text of rows id, ids. Bytes that aren't UTF-8 become replacement characters; null ids are none."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch, n, digests, texts = whole.slice(i, 500), [], [], []
                for x in batch.column(1):
                    ids = x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []
                    n.append(len(ids))
                    digests.append(hashlib.sha256(",".join(map(vocab.texts_of.__getitem__, ids)).encode()).hexdigest())
                    texts.append(vocab.decode(ids))
                yield batch.column(0), n, digests, texts

    return arrow_map(encoded.select("id", "ids"), run, "id long, n_tokens long, ids_sha256 string, text string")


def round_trip(df: DataFrame, vocab_path: str, size: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, text (decoded) of every row, encoded through a lexicon of the table's own frequent words."""
    return decode(encode(df, vocab_path, build_lexicon(df, vocab_path, text_col, size), id_col, text_col), vocab_path)
