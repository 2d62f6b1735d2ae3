"""Context mixing: base scores against brute force, codes that add up to one, scores by text alone, held-out gain."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framesift.llm import context_mixing as cm
from framesift.llm import queries
from framesift.llm.common import id_split

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [""]


def check_base(rows, documents):
    learned = [t for i, t in documents if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for t in learned for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = sorted(((i is None, i or 0), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in documents)
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.n_known, r.base_score) for r in rows)
    assert [x[:3] for x in found] == [x[:3] for x in wanted]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in wanted], rel=1e-9)
    assert {r.train_tokens for r in rows} == {n}


def test_op11_whole_table(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    documents = list(zip(table["doc_id"], table["text"]))
    rows = queries.op11_context_mixing(spark, sf_dir).collect()
    check_base(rows, documents)
    text = dict(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[text[r.doc_id]].add(r.score)
        assert r.score == pytest.approx(-r.total_bits * math.log10(2)) and r.score < 0
    assert all(max(x) - min(x) < 1e-6 * abs(min(x)) for x in by_text.values())
    # even odds in the same codes would take 8 bits a byte; held-out texts take far fewer
    held = [r for r in rows if r.held_out]
    assert sum(r.total_bits for r in held) / sum(r.n_bytes for r in held) < 3.2


AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "One one ONE"), (4, "One one ONE"), (None, "only without an id " * 3), (6, "héllo\x1cwörld\x85Ünïcode " * 40), (7, "x" * 100_000), (8, "a b " * 50_000), (9, "a b c"), (10, "one")]


def test_op11_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "rare": F.lit(2), "_row": F.lit(3), "known": F.lit(4)})
    model, counts = cm.fit(df.repartition(3), id_split("doc_id", 7) != 2)
    rows = cm.score(df, model, counts).collect()
    check_base(rows, AWKWARD)
    assert len({r.score for r in rows if r.n_tokens == 1}) == 1
    assert all(np.isfinite(r.score) for r in rows)
    # nothing to learn from, nothing to score
    model, counts = cm.fit(df, F.lit(False))
    found = cm.score(df, model, counts).collect()
    assert {r.train_tokens for r in found} == {0} and {r.n_known for r in found} == {0} and all(r.base_score == 0 for r in found)
    assert cm.score(df.where("false"), model, counts).collect() == []


def test_words_without_a_code_meet_their_counts(spark):
    """With a small share most words are spelled; the base score stays what it is."""
    documents = [(i, " ".join(f"w{(i * k) % 41}" for k in range(60))) for i in range(80)]
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    model, counts = cm.fit(df, id_split("doc_id", 7) != 2, settings=cm.Settings(share=30, least=1, bits=16))
    assert 1 < len(model.book.words) <= 31
    check_base(cm.score(df, model, counts).collect(), documents)


def small_model():
    words = [b"", b"the", b"of", b"a"]
    code = cm.huffman(np.array([5, 9, 4, 3, 2]))
    book = cm.Book(21, 5, words, np.array([5, 9, 4, 3]), code, cm.huffman(np.arange(256) % 7 + 1), 12)
    rng = np.random.default_rng(1)
    states = rng.integers(0, 1 << 16, -(-book.regions()[-1] // cm.BLOCK) * cm.BLOCK).astype(np.uint16)
    return cm.Model(book, states, rng.normal(0.3, 0.1, (cm.GATES, cm.INPUTS)), rng.normal(0, 0.1, (cm.GATES, cm.BUCKETS)))


def test_probabilities_add_up():
    """All next words after a context share one: those with a code, and the escape's part over all first bytes."""
    scorer = cm.Scorer(small_model())
    escape = len(scorer.coder.book.words)
    for before in range(escape):
        pairs = before * (escape + 1) + np.arange(escape + 1)
        costs = np.concatenate([np.array(scorer.costs(bits)) for _, bits in scorer.coder.pair_bits(pairs)], axis=1)
        assert (2.0**-costs).sum(axis=1) == pytest.approx([1.0] * len(cm.TRUST), rel=1e-4)
    # spelling: after any start, the next bytes' probabilities add up to one
    for start in (b"", b"x", b"th", b"abcd"):
        costs = []
        for byte in range(256):
            bits = scorer.coder._run_bits(np.frombuffer(start + bytes([byte]), np.uint8), np.array([len(start) + 1]))
            costs.append([c[0] for c in scorer.costs(bits)])
        whole = np.array([c[0] for c in scorer.costs(scorer.coder._run_bits(np.frombuffer(start, np.uint8), np.array([len(start)])))]) if start else 0
        assert (2.0 ** -(np.array(costs) - whole)).sum(axis=0) == pytest.approx([1.0] * len(cm.TRUST), rel=1e-4)


def test_bits_match_a_plain_loop():
    """Total bits of texts against a loop over tokens, bits and mixers, with runs of long words."""
    model = small_model()
    scorer, book = cm.Scorer(model), model.book
    texts = [b"The of xyz the", b"", b"a \xc3\xa9t\xc3\xa9 " + b"q" * (cm.LONGEST + 5), b"of"]
    part = cm.Part(scorer.coder, True)
    part.add(texts[:2])
    part.add(texts[2:])
    part.close()
    hashed = lambda r, c, node: int(scorer.coder._slot(r, np.array([c], np.uint32), np.array([node], np.uint32) * cm._THREE)[0])

    def cost(kind, slots, bit, trust):
        state = [int(model.states[s]) for s in slots]
        gate = int(cm.EVIDENCE[state[1]]) * 4 + int(cm.EVIDENCE[state[2]]) + 16 * kind
        odds = min(cm.LIMIT, max(-cm.LIMIT, trust * sum(float(w) * float(cm.ODDS[s]) for w, s in zip(model.weights[gate], state))))
        odds += model.correction[gate, round((odds + cm.LIMIT) * (cm.BUCKETS - 1) / (2 * cm.LIMIT))]
        return math.log2(1 + math.exp(-odds if bit else odds))

    wanted = []
    for text in texts:
        sums, before = [0.0] * len(cm.TRUST), 0
        for word in [*text.lower().split(), b""]:
            number = book.words.index(word) if word in book.words else len(book.words)
            code, todo = book.word_code, []
            for k in range(code.at[number], code.at[number] + code.size[number]):
                node = int(code.node[k])
                slots = [node, hashed(1, (min(before, 31) + 1) * int(cm._ONE) % 2**32, node), hashed(2, (min(before, 1023) + 1) * int(cm._TWO) % 2**32, node)]
                todo.append((0, slots, code.bit[k]))
            if number == len(book.words):
                for at in range(0, len(word), cm.LONGEST):
                    run = word[at : at + cm.LONGEST] + (b" " if at + cm.LONGEST >= len(word) else b"")
                    rolling = 0
                    for i, byte in enumerate(run):
                        a, b, c = (run[i - k] if i >= k else 0 for k in (1, 2, 3))
                        for k in range(book.byte_code.at[byte], book.byte_code.at[byte] + book.byte_code.size[byte]):
                            node = int(book.byte_code.node[k])
                            contexts = (a | b << 8) + 1, (a | b << 8) + 1 + (c << 16), rolling + i
                            todo.append((1, [hashed(r, x * int(cm._ONE) % 2**32, node) for r, x in zip((3, 4, 5), contexts)], book.byte_code.bit[k]))
                        # powers stand at places of the whole piece, so only differences from a word's start are the same
                        rolling = (rolling + (byte + 1) * pow(0x01000193, i, 2**32)) % 2**32
            for m, trust in enumerate(cm.TRUST):
                sums[m] += sum(cost(*x, trust) for x in todo)
            before = number
        low = min(sums)
        wanted.append(low - math.log2(sum(2 ** (low - s) for s in sums) / len(sums)))
    assert scorer.total_bits(part) == pytest.approx(wanted, rel=1e-4)


def test_huffman_is_a_prefix_code_with_few_bits():
    weights = np.array([50, 1, 1, 7, 30, 30, 2])
    code = cm.huffman(weights)
    words = ["".join(map(str, code.bit[a : a + n])) for a, n in zip(code.at, code.size)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    assert sum(2.0 ** -len(w) for w in words) == 1
    entropy = -(weights / weights.sum() * np.log2(weights / weights.sum())).sum()
    assert entropy <= (weights * code.size).sum() / weights.sum() < entropy + 1


def test_counts_in_a_byte():
    small = np.arange(33)
    assert (cm._VALUE[cm.coded(small)] == small).all()
    large = np.array([40, 1000, 10**6, 10**10])
    assert np.abs(cm._VALUE[cm.coded(large)] / large - 1).max() < 0.06


def test_text_groups_cover_all(monkeypatch):
    monkeypatch.setattr(cm, "GROUP", 100)
    texts = [None, "a" * 500, "", "b c", "é" * 30] * 4
    batch = pa.record_batch({"text": pa.array(texts)})
    found = list(cm.byte_groups(batch))
    assert [t for _, g in found for t in g] == [(t or "").encode() for t in texts]
    assert [s for s, _ in found] == np.cumsum([0, *(len(g) for _, g in found)])[:-1].tolist()
