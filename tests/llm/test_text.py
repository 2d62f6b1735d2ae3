"""Packing, host rules, edit-aware counts, classifiers and the Jaccard join."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framesift.llm import host_rules, jaccard_join, langid, packing, queries, rule_ensemble, token_edits, toxicity
from framesift.llm.common import ascii_words, id_split, space_words, table
from tests.oracle import assert_same, connect

AWKWARD = [(1, None, None), (2, "", "h"), (3, "   \n ", "h"), (4, "one", "h"), (5, "one two", None), (6, "lorem ipsum dolor " * 8000, "h"), (6, "lorem ipsum dolor " * 8000, "h"), (None, "no id at all", "h"), (8, "héllo\x1cwörld Ünïcode", "h"), (9, "same words here", "h"), (10, "SAME Words here", "g")]
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def awkward(spark):
    # columns whose names the operators use inside
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({"length": F.lit(1), "n": F.lit("x"), "label": F.lit(2), "key": F.lit(3), "node": F.lit(4)})


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# ---------------------------------------------------------------- packing


def check_packed(rows, lengths, capacity=4096):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= capacity
    assert sorted(r.length for r in rows) == sorted(lengths)
    return len(places)


def test_op2_packs_all_tokens(spark, sf_dir, documents):
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    wanted, lengths = {}, []
    for r in documents.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            wanted[r.doc_id, k] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            lengths.append(len(part))
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted
    bins = check_packed(rows, lengths)
    assert bins <= -(-sum(lengths) // 4096) + 1


def test_packing_awkward_rows(spark, awkward):
    rows = packing.pack_documents(awkward, P.path("word_bpe_49k.json")).collect()
    count = collections.Counter(r.doc_id for r in rows if r.piece == 0)
    assert count == collections.Counter(i for i, _, _ in AWKWARD)
    check_packed(rows, [r.length for r in rows])
    assert packing.pack_documents(awkward.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_in_blocks(spark):
    rnd = random.Random(5)
    lengths = [rnd.randint(1, 100) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id int, length int")
    bins = check_packed(packing.pack(df, capacity=100, block=400).collect(), lengths, 100)
    assert bins <= 1.02 * sum(lengths) / 100 + 1


def test_word_ids_equal_the_library():
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own, rnd = packing.WordIds(P.path("word_bpe_49k.json")), random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("abC'st  \n.,1é́Σς字\x1c <|endoftext|>") for _ in range(rnd.randint(0, 50)))
        assert own.ids(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_special_tokens_are_the_library_s():
    """The contract's plain call reads a special token's text as that token."""
    model, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.WordIds(P.path("word_bpe_49k.json"))
    for text in ("a<|endoftext|>b", "<|startoftext|> x <|ENDOFTEXT|> <| endoftext|>", "é—<|endoftext|>", "word " * 60_000 + "<|endoftext|>"):
        assert own.ids(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(own.ids("<|endoftext|>")) == 4


def test_memory_is_bounded_and_exact(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 6)
    model, own, rnd = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.WordIds(P.path("word_bpe_49k.json")), random.Random(3)
    for _ in range(80):
        text = " ".join(rnd.choice(["alpha", "beta's", "42", "été", "x!", "ÿñ", "gamma—ray"]) for _ in range(9))
        assert own.ids(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(own.known) <= 3 and len(own.known.old) <= 3


def test_local_search_empties_bins():
    # best fit first leaves three bins; exchanges fit the lengths into two
    bins = packing.best_fit([6, 5, 5, 4, 4, 3, 3], 15)
    searched = packing.local_search([list(b) for b in ([6, 5], [5, 4, 4], [3, 3])], 15)
    assert len(searched) == 2 and sorted(x for b in searched for x in b) == [3, 3, 4, 4, 5, 5, 6]
    assert all(sum(b) <= 15 for b in bins)
    rnd = random.Random(7)
    for _ in range(60):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 60))]
        first = packing.best_fit(lengths, 50)
        after = packing.local_search([list(b) for b in first], 50)
        assert sorted(x for b in after for x in b) == sorted(lengths) and all(0 < sum(b) <= 50 for b in after)
        assert len(after) <= len(first)


# ---------------------------------------------------------------- host rules


def test_op3_equals_sql(spark, sf_dir):
    assert_same(queries.op3_host_rules(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op3_host_rules"])


def test_statistics_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("ab  \n#| é") for _ in range(rnd.randint(0, 80)))
        words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text)]
        grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + s for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for s in range(3)}
        lines = [x for x in text.split("\n") if ascii_words(x)]
        assert host_rules.text_statistics(text) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_host_verdicts(spark, awkward):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(80)), "fine") for i in range(40)] + [(100, " ".join(f"w{j}##" for j in range(80)), "fine")]
    rows += [(200 + i, " ".join(f"w{j}##{i}" for j in range(80)), "junk") for i in range(40)] + [(300, " ".join(f"word{j}" for j in range(80)), "junk")]
    found = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[100]._kept and not found[205]._kept  # one slip is forgiven on a clean host, none on a bad one
    assert found[300]._kept  # what fails no rule stays, whatever its host
    judged = host_rules.judge(awkward).collect()
    assert len(judged) == len(AWKWARD) and all(r._base_failed for r in judged if (r.text or "") == "")
    assert host_rules.filter_documents(awkward).columns == awkward.columns
    assert host_rules.judge(awkward.limit(0)).count() == 0
    many = host_rules.judge(spark.createDataFrame(rows, SCHEMA), limits=host_rules.Limits(broadcast_hosts=0))
    assert {r.doc_id: r._kept for r in many.collect()} == {k: r._kept for k, r in found.items()}


def test_judge_keeps_what_is_asked(awkward):
    judged = host_rules.judge(awkward, keep=["doc_id", "length"])
    assert judged.columns == ["doc_id", "length", "_stats", "_base_failed", "_kept"] and judged.count() == len(AWKWARD)


def test_beta_prior():
    assert host_rules.beta_prior(0, 0, 0, 0, 0) == (0.0, 1.0)
    mu, strength = host_rules.beta_prior(200.0, 100.0, 20_000.0, 2.0, 100.0)  # one host all bad, one all good
    assert mu == 0.5 and strength < 0.01
    assert host_rules.beta_prior(200.0, 100.0, 20_000.0, 2.0, 50.0)[1] > 100  # no difference between hosts


# ---------------------------------------------------------------- edit-aware counts


def test_op4_equals_counting_again(spark, sf_dir):
    count = token_edits.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
    state = token_edits.build(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = token_edits.apply_edits(state.withColumn("edits", token_edits.sample_edits()), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert all(r.n_tokens == len(count(r.text)) == sum(r.run_tokens) and sum(r.run_chars) == len(r.text) for r in rows)
    assert sum(r.encoded_chars for r in rows if len(r.text) > 5_000) < sum(len(r.text) for r in rows if len(r.text) > 5_000)
    assert queries.op4_edit_counts(spark, sf_dir).count() == len(rows)


@pytest.mark.parametrize("run", [3, 20, 512])
def test_random_edits(run, monkeypatch):
    monkeypatch.setattr(token_edits, "RUN", run)
    encode, rnd, letters = token_edits.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary, random.Random(run), "ab  \n\t'sé1!  "
    count = lambda s: len(encode(s))
    for _ in range(150):
        document = token_edits.Document.build("".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 60, 400]))), count)
        for _ in range(8):
            start, insert = rnd.randint(-2, len(document.text) + 2), "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 80])))
            stop = start + rnd.choice([0, 0, 1, 10, 200])
            a = min(max(0, start), len(document.text))
            wanted = document.text[:a] + insert + document.text[min(max(a, stop), len(document.text)) :]
            document.edit(start, stop, insert)
            assert document.text == wanted and document.n_tokens == count(wanted)


def test_edit_groups(spark, awkward):
    edits = spark.createDataFrame([(4, 2, 0, 0, "b "), (4, 1, 0, 3, "a"), (4, 3, None, 1, "x"), (99, 1, 0, 0, "y"), (2, 1, 5, 9, "new text")], "doc_id bigint, seq int, start int, stop int, insert string")
    state = token_edits.build(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).join(token_edits.grouped(edits), "doc_id", "left")
    found = {r.doc_id: r.text for r in token_edits.apply_edits(state, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert found[4] == "b a" and found[2] == "new text" and found[1] == "" and len(found) == 10
    assert token_edits.build(awkward.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# ---------------------------------------------------------------- classifiers


def accuracy(found, truth, column):
    both = found.join(truth, "doc_id").where("held_out").select("predicted", column).collect()
    return sum(r[0] == r[1] for r in both) / len(both), both


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.01"
    share, _ = accuracy(queries.op6_rule_ensemble(spark, sf), table(spark, sf, "labels"), "quality")
    assert share >= 0.97


def test_rules_from_a_printed_tree():
    text = "Tree: depth=2\n  If (feature 0 <= 1.5)\n   If (feature 0 <= 0.5)\n    Predict: 0.0\n   Else (feature 0 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0E-3\n"
    assert rule_ensemble.paths(text) == {((0, False, 1.5),), ((0, False, 0.5),), ((0, False, 1.5), (0, True, 0.5)), ((0, True, 1.5),)}


def test_rules_on_awkward_rows(spark, awkward):
    model = rule_ensemble.Model([((("n_words", True, 2.0), ("upper", False, 0.5)), 2.0), ((("n_words", False, 0.0),), -3.0)], 0.5)
    found = rule_ensemble.with_score(awkward, model)
    assert found.columns == [*awkward.columns, "_score"] and found.count() == len(AWKWARD)
    scores = {r.doc_id: r._score for r in found.collect()}
    assert scores[1] == scores[2] == scores[3] == pytest.approx(1 / (1 + np.exp(2.5))) and scores[9] == pytest.approx(1 / (1 + np.exp(-2.5)))
    none = rule_ensemble.fit(awkward.select("doc_id", "text"), spark.createDataFrame([], "doc_id bigint, quality int"), id_split("doc_id", 4) != 2)
    assert none.rules == []


def test_compiled_rules_equal_direct_evaluation(spark, sf_dir):
    """The column expression against plain Python over the same statistics, for a fitted model."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(documents, table(spark, sf_dir, "labels"), id_split("doc_id", 4) != 2, settings=rule_ensemble.Settings(trees=6))
    assert model.rules
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rule_ensemble.with_score(documents, model).collect():
        s = dict(zip(rule_ensemble.STATISTICS, rule_ensemble.text_statistics(texts[r.doc_id] or "")))
        total = model.constant + sum(w for rule, w in model.rules if all(s[f] > t if above else s[f] <= t for f, above, t in rule))
        assert r._score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


def test_rules_do_not_depend_on_order_or_tasks(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = lambda docs, marks: rule_ensemble.fit(docs, marks, id_split("doc_id", 4) != 2, settings=rule_ensemble.Settings(trees=6))
    found = learn(documents, labels)
    assert found.rules and found == learn(documents.repartition(7, "text"), labels.orderBy(F.desc("doc_id")).repartition(5, "quality"))


def test_samples_are_bounded_and_repeatable(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(7, "an earlier text"), (7, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)] + [(None, 1), (5, None), (6, 7)], "doc_id bigint, toxic int")
    take = lambda order: sorted(map(tuple, toxicity.sample_rows(spark.createDataFrame(order, "doc_id bigint, text string").repartition(3), labels, F.lit(True), 40, "doc_id", "text", "toxic").collect()))
    found = take(rows)
    assert [sum(label == k for _, label in found) for k in (0, 1)] == [40, 40] and found == take(rows[::-1])


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.01"
    both = queries.op7_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in both) / len(both) >= 0.98 and all(0 <= r.score <= 1 for r in both)


def test_language_of_awkward_rows(spark, awkward):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("el gato y el perro", "es")] * 5)], "doc_id bigint, text string, lang string")
    model = langid.fit(train, F.lit(True))
    found = {r.doc_id: r for r in langid.predict(awkward, model).collect()}
    assert found[1].lang_pred == found[2].lang_pred == found[3].lang_pred == "und" and found[1].score == 0
    assert found[4].lang_pred in ("en", "es") and langid.predict(awkward.limit(0), model).count() == 0
    digits = spark.createDataFrame([(1, "123 !?")], "doc_id bigint, text string")
    assert langid.predict(digits, model).first().lang_pred == "und"
    assert langid.predict(train, langid.fit(train.limit(0), F.lit(True))).first().lang_pred == "und"


def test_language_scores_equal_explicit_kernels(spark):
    """Folded scores against kernels of texts with landmarks, Nyström features and a ridge solved in the open."""
    rnd, parts = random.Random(2), {"en": ["the ", "dog ", "and ", "walk "], "es": ["el ", "perro ", "que ", "anda "], "fr": ["le ", "chien ", "et ", "vœu "]}
    train = [(i, "".join(rnd.choice(parts[k]) for _ in range(rnd.randint(2, 9))), k) for i in range(60) for k in parts]
    train = [(n, t, k) for n, (_, t, k) in enumerate(train)]
    settings = langid.Settings(sample=30, landmarks=12, ridge=1e-3)
    df = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    model = langid.fit(df, F.lit(True), settings=settings)
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    grams = langid.Grams()
    kernel = lambda a, b: len(np.intersect1d(a, b)) / (len(a) * len(b)) ** 0.5
    names, own = sorted(parts), {}
    for k in names:
        own[k] = [grams.present(t) for _, t in sorted((order[i], t) for i, t, lang in train if lang == k)[:30]]
    marks = [g for k in names for g in own[k][:4]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    good = values > 1e-8 * values.max()
    half = vectors[:, good] * values[good] ** -0.5
    feature = lambda g: np.append(np.array([kernel(g, m) for m in marks]) @ half, 1.0)
    rows = [(feature(g), k) for k in names for g in own[k]]
    x, weight = np.array([f for f, _ in rows]), np.array([1 / len(own[k]) / 3 for _, k in rows])
    y = np.array([[1.0 if k == c else -1.0 for c in names] for _, k in rows])
    solved = np.linalg.solve(x.T @ (x * weight[:, None]) + settings.ridge * np.eye(x.shape[1]), x.T @ (y * weight[:, None]))
    probes = [(1, "the perro and"), (2, "le chien que"), (3, "walk walk anda")]
    found = {r.doc_id: r for r in langid.predict(spark.createDataFrame(probes, "doc_id int, text string"), model).collect()}
    for i, text in probes:
        outputs = feature(grams.present(text)) @ solved
        odds = np.exp(settings.sharpness * (outputs - outputs.max()))
        assert found[i].lang_pred == names[outputs.argmax()] and found[i].score == pytest.approx(odds.max() / odds.sum(), abs=1e-6)


@pytest.mark.parametrize("floor", [toxicity.FLOOR, 0.2, 0.0])
def test_kernel_equals_explicit_subsequences(floor):
    """Kernel values against a plain enumeration of subsequences and their weights."""

    def weights(unit):
        found = collections.Counter()
        for i in range(len(unit)):
            for j in range(i + 1, len(unit)):
                for k in range(j + 1, len(unit)):
                    if j - i <= 3 and k - j <= 3 and k - i <= 5:
                        found[unit[i], unit[j], unit[k]] += toxicity.DAMPING ** (k - i - 2)
        return found

    def plain(a, b):
        x, y = weights(f"\x02{a}\x03"), weights(f"\x02{b}\x03")
        return sum(x[s] * y[s] for s in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    marks, units = ["idiot", "clown", "worthless"], ["idiot", "idi0t", "idxiot", "clowns", "clawn", "worthles", "harmless", "tree", "idiotidiot"]
    found = toxicity.Landmarks(marks, floor).kernel(units)
    for k, u in enumerate(units):
        for j, m in enumerate(marks):
            exact = plain(u, m)
            if abs(exact - floor) > 0.01 or not floor:
                assert (found[k][j] if k in found else 0) == pytest.approx(exact if exact >= floor else 0, abs=0.01), (u, m)


def test_floor_travels_with_the_model(spark):
    rows = [(i, f"you are such an idiot number {i}" if i % 2 else f"the harbour opens at nine today {i}", i % 2) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    settings = toxicity.Settings(floor=0.0, least_evidence=5.0)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.col("doc_id") >= 0, settings=settings)
    assert model.floor == 0.0 and "idiot" in model.units
    reader = toxicity.Reader(toxicity.Landmarks(model.units, 0.0))
    for r in toxicity.score(docs, model, ("doc_id", "text")).collect():
        assert r.score == model.score(*reader.sentences([r.text])[0])


def test_scores_depend_on_the_text_alone():
    """One text after different reading histories, and beside different neighbours."""
    marks = ["idiot", "clown", "stupid"]
    model = toxicity.Model(marks, np.array([1.5, 1.0, 0.5]), -0.7, np.array([1.0, 0.8, 0.2, -0.5]))
    text = "You IDIOT, an idiot!! i d i o t and Idiot. St-upid clown; clown CLOWN."
    histories = [[], ["Idiot"], ["idiot", "IDIOT CLOWN"], ["clown; stupid", "other words " * 50, "i d i o t"]]
    scores = set()
    for history in histories:
        reader = toxicity.Reader(toxicity.Landmarks(marks))
        for t in history:
            reader.sentences([t])
        scores |= {model.score(*s) for s in (reader.sentences([text])[0], reader.sentences(["some idiot", text])[1])}
    assert len(scores) == 1
    n_words, sentences = toxicity.Reader(toxicity.Landmarks(marks)).sentences([text])[0]
    assert {u for s in sentences for u, _ in s} == {"idiot", "st-upid", "clown"} and n_words == 15


def test_op9_held_out(spark):
    sf = "/root/testdata/sf0.1"
    share, both = accuracy(queries.op9_toxicity(spark, sf), table(spark, sf, "labels"), "toxic")
    caught = sum(r[0] == r[1] == 1 for r in both)
    assert share >= 0.95 and caught >= 0.85 * sum(r[1] for r in both)


def test_gapped_insults(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(30)]
        if i % 4 == 0:
            text[rnd.randrange(30)] = rnd.choice(["worthless", "idiot"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    base = " ".join(words[:30])
    cases = ["worthless", "worth-less", "wor.th.less", "w o r t h l e s s", "WORTHLESS!!!", "worthlesss", "idiot", "i-d-i-o-t"]
    tests = spark.createDataFrame([(i, f"{base} {c} {base}") for i, c in enumerate(cases)] + [(100, base), (101, None), (102, "")], "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(tests, model).collect()}
    assert all(scores[i] > 0.5 for i in range(len(cases))) and max(scores[100], scores[101], scores[102]) < 0.3
    assert toxicity.score(tests.limit(0), model).count() == 0


def test_disguised_insults():
    """Disguised insults keep a kernel value with the plain word; two replaced characters of a short word share too little with it."""
    rnd = random.Random(1)
    words = ["idiot", "trash", "clown", "loser", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting"]
    marks, exact = toxicity.Landmarks(words), toxicity.Landmarks(words, 0.0)

    def inserted(w, n):
        for _ in range(n):
            i = rnd.randrange(1, len(w))
            w = w[:i] + rnd.choice("abcdefghijklmnopqrstuvwxyz1347*.-_") + w[i:]
        return w

    def replaced(w, n, by):
        for i in rnd.sample(range(1, len(w) - 1), n):
            w = w[:i] + rnd.choice(by) + w[i + 1 :]
        return w

    def recall(disguise, marks=marks):
        units = [(k, toxicity.normal(disguise(w))) for k, w in enumerate(words) for _ in range(60)]
        near = marks.kernel([u for _, u in units])
        return sum(i in near and near[i][k] > 0 for i, (k, _) in enumerate(units)) / len(units)

    assert recall(lambda w: inserted(w, 1)) == recall(lambda w: replaced(w, 1, "*")) == 1
    assert recall(lambda w: inserted(w, 2)) >= 0.95 and recall(lambda w: replaced(w, 1, "0134578")) >= 0.85
    assert recall(lambda w: replaced(w, 2, "*")) >= 0.45 and recall(lambda w: replaced(w, 2, "0134578")) >= 0.2
    # without a floor hardly any disguise leaves nothing
    assert recall(lambda w: replaced(w, 2, "*"), exact) >= 0.9 and recall(lambda w: replaced(w, 2, "0134578"), exact) >= 0.8
    assert recall(lambda w: inserted(w, 2), exact) == 1


# ---------------------------------------------------------------- Jaccard join


def brute(rows, k, percent):
    sets, posts = [], collections.defaultdict(list)
    for i, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
        for g in sets[-1]:
            posts[g].append(i)
    overlaps = collections.Counter((a, b) for v in posts.values() for n, b in enumerate(v) for a in v[:n])
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), o in overlaps.items():
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            parent[top(a)] = top(b)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[top(i)] = min(low.get(top(i), key), key)
    return sorted(str((key, len(sets[i]), low.get(top(i)))) for i, (key, _) in enumerate(rows))


def joined(df, **settings):
    return sorted(str(tuple(r)) for r in jaccard_join.join(df, settings=jaccard_join.Settings(**settings)).collect())


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, documents, k, percent):
    rnd = random.Random(k)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    base = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(n)) for n in (12, 60, 150, 400)]
    for i in range(240):
        words = base[i % 4].split()
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(400)}"
        rows.append((10_000 + i, " ".join(words)))
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(20_000 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(rnd.randrange(80)))) for i in range(80)]
    rows += [(i, t) for i, t, _ in AWKWARD if i is not None]
    rnd.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), words=k, percent=percent) == brute(rows, k, percent)


def test_join_awkward_rows(spark, awkward):
    found = jaccard_join.join(awkward, settings=jaccard_join.Settings(words=3, percent=90)).collect()
    assert len(found) == len(AWKWARD)
    component = {r.doc_id: r.component_id for r in found}
    assert component[9] == component[10] == 9 and component[1] == 1 and component[2] == 2
    assert {r.n_shingles for r in found if r.doc_id in (1, 2, 3)} == {0} and {r.n_shingles for r in found if r.doc_id == 4} == {1}
    kept = jaccard_join.keep_first(awkward, settings=jaccard_join.Settings(words=3, percent=90))
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert jaccard_join.join(awkward.limit(0)).count() == 0
    assert joined(awkward, words=3, percent=90, broadcast_ids=0) == joined(awkward, words=3, percent=90)


def test_join_null_and_repeated_ids(spark):
    """Rows with a null id link and bridge; an id may stand on several rows with other texts."""
    text = [f"w{j}" for j in range(100)]
    change = lambda n: " ".join(f"x{j}" if j % 30 < n else w for j, w in enumerate(text))
    chain = [" ".join([f"a{j}" for j in range(k)] + [f"b{j}" for j in range(k, 100)]) for k in range(0, 45, 5)]
    rows = [(1, change(0)), (None, change(1)), (None, change(2)), (2, change(0)), (3, "some other text with words of its own"), (3, change(0)), (None, None), (None, "p q r s t u v")]
    rows += [(None if k % 2 else 10 + k, t) for k, t in enumerate(chain)] + [(None, chain[3]), (None, " ".join(f"n{j}" for j in range(50)))]
    wanted = brute(rows, 3, 80)
    assert sum(f"(None, 98, {i})" in wanted for i in (1, 10)) == 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for broadcast_ids in (0, 1000):
        assert joined(df, words=3, percent=80, broadcast_ids=broadcast_ids) == wanted


def test_keep_first_decides_by_row(spark):
    """An id on two rows, a copy and a text of its own: only the copy goes; a null id with the same text goes, too."""
    copy, lone = " ".join(f"w{j}" for j in range(40)), " ".join(f"n{j}" for j in range(40))
    rows = [(1, copy, "a"), (2, copy, "a"), (2, "a text that no other row has", "b"), (3, copy, "a"), (None, copy, "c"), (None, lone, "c"), (None, lone, "c"), (None, "one more text without an id", "c"), (None, None, "c"), (None, "", "c")]
    rows += [(4, "", "d"), (4, copy, "d"), (5, "said twice under one id", "d"), (5, "said twice under one id", "d"), (6, None, "e"), (6, None, "e")]
    wanted = [rows[0], rows[2], *rows[6:11], rows[12], *rows[14:]]
    for broadcast_ids in (0, 1000):
        kept = jaccard_join.keep_first(spark.createDataFrame(rows, SCHEMA), settings=jaccard_join.Settings(words=3, percent=80, broadcast_ids=broadcast_ids))
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, wanted))


def test_join_with_split_groups(spark, monkeypatch):
    """Groups dealt over many parts, and shingles so frequent that their numbers tell logarithms, change nothing."""
    monkeypatch.setattr(jaccard_join, "PART", 4)
    monkeypatch.setattr(jaccard_join, "OFTEN", 16)
    rnd, base = random.Random(8), [f"w{j}" for j in range(60)]
    rows = []
    for i in range(150):
        words = list(base) if i % 2 else [f"v{i % 10}_{j}" for j in range(60)]
        for _ in range(rnd.choice([0, 1, 2, 5])):
            words[rnd.randrange(60)] = f"x{rnd.randrange(90)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:12]) + f" u{i}") for i in range(60)]
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=80) == brute(rows, 3, 80)


def test_sets_with_many_copies(spark, monkeypatch):
    """Sets that hold a large part of all rows, linked or alone, are named as others are."""
    monkeypatch.setattr(jaccard_join, "PART", 8)
    words = [f"w{j}" for j in range(50)]
    rows = [(i, " ".join(words)) for i in range(40, 70)] + [(30, " ".join(words[:-1] + ["x"]))] + [(i, "another text that stands on many rows of the table") for i in range(100, 120)]
    rows += [(i, f"one of its own {i} {i + 1} {i + 2}") for i in range(200, 220)] + [(300, None), (None, " ".join(words))]
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), words=3, percent=80) == brute(rows, 3, 80)


def test_op8_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(queries.op8_jaccard_join(spark, sf), connect(sf), queries.oracle_sql()["op8_jaccard_join"])


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 200), (200, 300), (50, 50)]
    found = {r.node: r.comp for r in jaccard_join.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found[i] == 0 for i in range(21)) and found[300] == 100 and found[50] == 50


def test_words():
    assert ascii_words("a b \x1cc\td") == ["a b", "\x1cc", "d"] and space_words("a b \x1cc\td") == ["a", "b", "\x1cc", "d"]


def test_op7_keeps_a_language_of_few_ids_on_many_rows(spark):
    english, french = "the quick brown fox jumps over a lazy dog near the river bank", "le renard brun saute par dessus un chien paresseux près de la rivière"
    rows = spark.range(3000).select("id", F.concat(F.lit(english + " "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(50_000).select((F.col("id") % 10 + 10_000).alias("id"), F.concat(F.lit(french + " "), (F.col("id") % 10).cast("string")).alias("text"), F.lit("fr").alias("lang"))
    docs = rows.unionByName(few).withColumnRenamed("id", "doc_id")
    model = langid.fit(docs, F.lit(True))
    assert model.languages == ["en", "fr"]
    asked = spark.createDataFrame([(1, french), (2, english)], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {1: "fr", 2: "en"}
