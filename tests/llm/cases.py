"""Small documents with the hard cases, and plain versions of the operators."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import xxhash

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Extra columns whose names the operators use themselves.
EXTRA = ["bits", "block", "row", "n_words", "word", "host", "shard", "n", "hit", "kept", "record_id", "segment", "__m", "component_id",
         "__text", "__hash", "__id", "__n_hit", "__spans", "__items", "n_hit", "spans", "windows", "doc", "id", "hash", "rest", "bits_", "of_id", "text_hash"]


def texts():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["The", "the", "of.", "é", "日本", "x_y", "1", "Naïve,"]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, base = prose(60), prose(120)
    near = base.split(" ")
    near[60] = "changed"
    return [None, "", " ", "\n\n \t", "one", "a b c", prose(34), prose(35), base, base, base, " ".join(near), passage, prose(30) + " " + passage + "\n" + prose(40),
            passage + " " + passage, "same " * 80, "\x0b".join(["x"] * 50), prose(3000), "▁ a\x1cb  c ▁", "line\nline\n\nline\nother\n" * 12,
            prose(20) + " #$%&|<>* " + prose(40), "<|endoftext|> <s> </s> it's 12,5.", "é " * 40 + "ÀÉ H̱ é"]


def documents(spark, extra=True):
    """Null and repeated ids, repeated rows, clashing names of extra columns."""
    rows = [(i if i % 7 else None, t, "src0" if i % 3 else None, i) for i, t in enumerate(texts())]
    rows += [rows[4], rows[4], rows[9], (9, "another text with the same id", "src1", 0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    return df.selectExpr("*", *[f"'e' AS `{c}`" for c in EXTRA]) if extra else df


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def word_ids(many):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [e.ids + [1] for e in model.encode_batch([t or "" for t in many], add_special_tokens=False)]


def piece_counts(many):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return [len(model.encode(t or "")) for t in many]


def without_windows(many, size):
    found = [words(t) for t in many]
    starts = Counter(tuple(w[i:i + size]) for w in found for i in range(len(w) - size + 1))
    out = []
    for w in found:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if starts[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, near):
    """Root place of each print, by all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER).decode())


def contaminated(many, items, size=10):
    windows = {}
    for name, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(name)
    out = []
    for text in many:
        w = bench_words(text)
        hit, names = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit[i:i + n] = [True] * n
                    names |= windows[tuple(w[i:i + n])]
        out.append((len(w), sum(hit), sorted(names)))
    return out


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            again[i:i + 3] = [True] * 3
    n = sum(again)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w))
