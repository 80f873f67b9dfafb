"""Language, quality and toxicity: against plain versions, on held-out rows and on awkward inputs."""

from __future__ import annotations

import math
import re
import time
import zlib

import helpers
import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tessella.llm import language, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    """A model of two languages with uneven, made-up piece probabilities."""
    vocab = language.vocabulary(language.default_path())
    rng = np.random.default_rng(4)
    shares = rng.random((len(vocab), 2))
    shares = np.concatenate([shares / shares.sum(0), [[language.UNKNOWN] * 2, [0, 0]]])
    return language.Model(language.default_path(), ["aa", "bb"], shares)


def all_segmentations(word, shares, vocab):
    """The sum over all ways to cut ``word``, and the expected uses of each piece, by enumeration."""
    index = {x: i for i, x in enumerate(vocab.pieces)}
    total, uses = 0.0, {}

    def walk(rest, so_far, chosen):
        nonlocal total
        if not rest:
            total += so_far
            for x in chosen:
                uses[x] = uses.get(x, 0) + so_far
            return
        for n in range(1, len(rest) + 1):
            i = index.get(rest[:n], len(vocab) if n == 1 else None)
            if i is not None:
                walk(rest[n:], so_far * shares[i], [*chosen, i])

    walk(language.MARK + word, 1.0, [])
    return total, {i: n / total for i, n in uses.items()}


def test_forward_sums_all_segmentations(model):
    vocab = language.vocabulary(language.default_path())
    words = ["a", "the", "thing", "straße", "ciónes", "ẘẘx", "日本", "nation"]
    logs = model.word_logs(words)
    for i, word in enumerate(words):
        for lang in range(2):
            assert math.isclose(logs[i, lang], math.log(all_segmentations(word, model.shares[:, lang], vocab)[0]), rel_tol=1e-9)


def test_expected_uses(model):
    vocab = language.vocabulary(language.default_path())
    words, counts = ["the", "thing", "ẘa", "ab"], np.array([3.0, 1.0, 2.0, 5.0])
    found = language.expected_uses(words, counts, model.shares[:, 0], vocab)
    expected = np.zeros(len(found))
    for word, n in zip(words, counts, strict=True):
        for i, uses in all_segmentations(word, model.shares[:, 0], vocab)[1].items():
            expected[i] += n * uses
    assert np.allclose(found, expected)


def test_long_words_are_rescaled(model):
    """The rescaled sums equal those in logarithms by a plain recursion."""
    vocab = language.vocabulary(language.default_path())
    index = {x: i for i, x in enumerate(vocab.pieces)}
    word = "thingness" * 40
    text, logs = language.MARK + word, [0.0]
    for end in range(1, len(text) + 1):
        terms = []
        for n in range(1, min(vocab.longest, end) + 1):
            i = index.get(text[end - n : end], len(vocab) if n == 1 else None)
            if i is not None:
                terms.append(logs[end - n] + math.log(model.shares[i, 0]))
        most = max(terms)
        logs.append(most + math.log(sum(math.exp(x - most) for x in terms)))
    assert math.isclose(model.word_logs([word])[0, 0], logs[-1], rel_tol=1e-9)


def test_expected_uses_of_long_words(model, monkeypatch):
    """Rescaled or not, the same uses; and each letter of a very long word is used once."""
    vocab = language.vocabulary(language.default_path())
    words, counts = ["thingnessless", "straßenbahnen", "x" * 13], np.array([3.0, 1.0, 2.0])
    plain = language.expected_uses(words, counts, model.shares[:, 0], vocab)
    monkeypatch.setattr(language, "LONG", 2)
    assert np.allclose(language.expected_uses(words, counts, model.shares[:, 0], vocab), plain, rtol=1e-9)
    word = "thingnessяя日本" * 400
    found = language.expected_uses([word], np.array([2.0]), model.shares[:, 1], vocab)
    sizes = np.array([*map(len, vocab.pieces), 1, 0])
    assert math.isclose((found * sizes).sum(), 2 * (len(word) + 1), rel_tol=1e-6)


def test_long_words_are_learned_from(spark):
    """Two languages whose words all have more than LONG letters."""
    rng = np.random.default_rng(5)
    letters = {"aa": list("abcdefg"), "bb": list("nopqrst")}
    rows = [(i, " ".join("".join(rng.choice(letters[x], 60)) for _ in range(20)), x, "s", 1) for i, x in enumerate(["aa", "bb"] * 10)]
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    learned = language.train(docs, F.col("doc_id") >= 14, language.default_path())
    found = {r["doc_id"]: r["lang_pred"] for r in language.predicted(docs, learned).collect()}
    assert learned.langs == ["aa", "bb"] and found == {r[0]: r[2] for r in rows}


def test_very_long_words_take_time_in_proportion(model):
    took = []
    for n in (20_000, 80_000):
        word = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnop"), n))
        began = time.process_time()
        assert np.isfinite(model.word_logs([word])).all()
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1 and took[1] < 8
    assert not any(len(w) > language.LONGEST for w in model._cache[0])


@pytest.mark.parametrize("text", [None, "", " \n", "12 3.4", "½ ² Ⅷ", "_ - !"])
def test_texts_without_letters(model, text):
    assert model.predict([text, "a"])[0] == ("und", 0.0) and model.predict(["½ a"])[0][0] != "und"


def test_tiny_probabilities_do_not_underflow(model):
    shares = np.where(model.shares > 0, 1e-9, 0)
    tiny = language.Model(model.path, model.langs, shares)
    for n in (5, 20, 21, 40, 41, 300):
        logs = tiny.word_logs(["я" * n])
        assert np.isfinite(logs).all()
        assert tiny.predict(["я" * n]) == [("aa", 0.5)]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = language.op3_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(found) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held) > 200
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_awkward(spark):
    docs = helpers.awkward(spark)
    learned = language.train(docs.select("doc_id", "text", "lang"), F.lit(False), language.default_path())
    assert learned.langs == ["en"]
    found = {r["doc_id"]: r for r in language.predicted(docs, learned).collect() if r["doc_id"] is not None}
    letters = {i for i, t in helpers.AWKWARD if re.search(r"[^\W\d_]", t or "")}
    assert all((r["lang_pred"] == "und") == (i not in letters) for i, r in found.items())
    assert language.accepted(docs, learned).columns == docs.columns
    nothing = language.train(helpers.empty(spark).select("doc_id", "text", "lang"), F.lit(False), language.default_path())
    assert nothing.langs == [] and {r["lang_pred"] for r in language.predicted(docs, nothing).collect()} == {"und"}
    assert language.predicted(helpers.empty(spark), learned).collect() == []


def plain_log_sums(word, shares, index, longest):
    """(log of the word's sum over segmentations, expected uses of pieces), by plain recursions in logarithms."""
    text, n = language.MARK + word, len(word) + 1

    def piece(start, size):
        return index.get(text[start : start + size], len(index) if size == 1 else None)

    def add(terms):
        most = max(terms, default=-math.inf)
        return most + math.log(sum(math.exp(x - most) for x in terms)) if most > -math.inf else most

    arcs = [(s, s + k, i) for s in range(n) for k in range(1, min(longest, n - s) + 1) if (i := piece(s, k)) is not None]
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for end in range(1, n + 1):
        forward[end] = add([forward[s] + math.log(shares[i]) for s, e, i in arcs if e == end])
    for start in range(n - 1, -1, -1):
        backward[start] = add([backward[e] + math.log(shares[i]) for s, e, i in arcs if s == start])
    uses = {}
    for s, e, i in arcs:
        uses[i] = uses.get(i, 0) + math.exp(forward[s] + math.log(shares[i]) + backward[e] - forward[n])
    return forward[n], uses


def test_language_query_against_a_plain_version(spark, tmp_path):
    """All rows of the query on a small table, learned and scored without arrays."""
    known = {"en": "the cat and a dog", "de": "der hund und die katze", "xx": "aaaaaaaaaaaaaaaaaaaaaaaabbbbbbbb bb"}
    rows = [(i, f"{text} {text.split()[i % 2]} {i}", lang, "s", 1) for i in range(9) for lang, text in list(known.items())[i % 3 : i % 3 + 1]]
    rows += [(20 + i, t, None, "s", 1) for i, t in enumerate([None, "", "die the", "b" * 30, "Katze Dog", "½", "я日"])]
    rows += [(40, "the", "en", "s", 1), (41, None, "en", "s", 1), (None, "der", "de", "s", 1)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    vocab = language.vocabulary(language.default_path())
    index = {x: i for i, x in enumerate(vocab.pieces)}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts = {}
    for i, text, lang, *_ in rows:
        if i is not None and text and lang and not held(i):
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                counts.setdefault(lang, {}).setdefault(word, 0)
                counts[lang][word] += 1
    size, shares = len(index), {}
    for lang, words in counts.items():
        own = [1 / size] * size + [language.UNKNOWN]
        for _ in range(language.ITERATIONS):
            total = [0.0] * (size + 1)
            for word, n in words.items():
                for i, u in plain_log_sums(word, own, index, vocab.longest)[1].items():
                    total[i] += n * u
            every = sum(total[:size]) + language.SMOOTHING * size
            own = [(x + language.SMOOTHING) / every for x in total[:size]] + [language.UNKNOWN]
        shares[lang] = own
    found = language.op3_language_id(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    ours = {r["doc_id"]: r for r in found}
    for i, text, *_ in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        logs = {x: sum(plain_log_sums(w, shares[x], index, vocab.longest)[0] for w in words) for x in sorted(shares)}
        best = max(logs, key=logs.get) if any(c.isalpha() for w in words for c in w) else "und"
        score = 1 / sum(math.exp(x - logs[best]) for x in logs.values()) if best in logs else 0.0
        assert ours[i]["lang_pred"] == best and math.isclose(ours[i]["score"], score, rel_tol=1e-6, abs_tol=1e-9)
        assert ours[i]["held_out"] == (i is not None and held(i))


def plain_base(text):
    words = helpers.WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if helpers.WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def test_quality_base_counts(spark):
    short = [(i, t) for i, t in helpers.AWKWARD if t != helpers.LONG]
    short += [(100, "w " * 40 + "a b c\na b c\n" * 9), (101, "\n".join(f"l{i % 7} x" for i in range(60)))]
    found = quality.quality(helpers.documents(spark, short, extra=True)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    ours = sorted([(r["doc_id"] or 0, *(r[n] for n in names)) for r in found])
    assert ours == sorted((i or 0, *plain_base(t)) for i, t in short)
    assert all(not r["kept"] for r in found if r["base_failed"])
    long = quality.measure(helpers.LONG).base
    assert long[0] == 60_000 and long[4] == 60_000
    assert quality.quality(helpers.empty(spark)).collect() == []


def test_quality_against_sql(spark, sf_dir):
    assert_same(quality.op5_quality_rules(spark, sf_dir), registry.oracle_sql()["op5_quality_rules"], sf_dir)


def test_repeats_with_very_many_words():
    """Word numbers that three of don't fit into 63 bits."""
    words = [f"w{i}" for i in range(1_200_000)]
    text = " ".join([*words, *words[5:9]])
    assert quality.measure(text).base[4] == 8


def test_distances():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert quality.distances(p, p) == 0 and math.isclose(float(quality.distances(p, q)), 1.0)


def test_quality_keeps_clean_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = quality.op5_quality_rules(spark, SF).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in found if r["quality"] == 1]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_references_are_the_whole_corpus(spark):
    docs = [(1, "The the cat. Sat! 12"), (2, "the  dog"), (3, None)]
    refs = quality.references(helpers.documents(spark, docs), 2)
    text = "The the cat. Sat! 12the  dog"
    assert refs.langs == ["en"]
    shares = {n: s for n, s in zip(quality.CLASSES, refs.classes[0], strict=True)}
    assert math.isclose(shares["digit"], 2 / len(text)) and math.isclose(shares["upper"], 2 / len(text))
    words = {w: refs.words[0, list(refs.columns[0]).index(i)] for w, i in refs.index.items()}
    assert words[b"the"] == 3 / 7 and math.isclose(refs.words[0].sum(), 1)


def test_long_words_count(spark):
    """Clean documents of one source, most of whose words have more than LONGEST bytes."""
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x0E01, 0x0E2F)]
    vocabulary = ["".join(rng.choice(letters, 4 if i < 60 else 12)) for i in range(300)]
    weights = np.concatenate([np.full(60, 0.1 / 60), np.full(240, 0.9 / 240)])
    docs = helpers.documents(spark, [(i, " ".join(rng.choice(vocabulary, 400, p=weights))) for i in range(40)])
    assert quality.accepted(docs).count() == 40
    assert quality.quality(docs).filter("kept and word_distance < 0.3").count() == 40
    few = helpers.documents(spark, [(1, "ab ab cd " + 2 * ("X" * 30 + ". ") + "--")])
    refs = quality.references(few, 2)
    assert np.allclose(refs.words[0], 1 / 3)
    assert quality.judge("ab ab cd " + 2 * ("x" * 30 + " ") + "--", refs)[-1] < 1e-6


def test_script_without_spaces(spark):
    """Sentences are words of more than LONGEST bytes; the word distance still tells a foreign text."""
    rng = np.random.default_rng(8)
    parts = ["今日は", "明日も", "東京に", "行きます", "雨が降る", "でしょう", "とても", "寒いです", "本を読む", "音楽を聞く"]
    sentences = ["".join(rng.choice(parts, 5)) + "。" for _ in range(60)]
    assert min(len(x.encode()) for x in sentences) > quality.LONGEST
    docs = [(i, " ".join(rng.choice(sentences, 80))) for i in range(30)]
    refs = quality.references(helpers.documents(spark, docs))
    assert len(refs.index) == 60 and math.isclose(refs.words[0, :-1].sum(), 1)
    own, foreign = quality.judge(docs[0][1], refs), quality.judge("some other words that nobody knows here " * 12, refs)
    assert own[-1] < 0.5 and foreign[-1] > 0.99


def test_quality_sql_counts_long_words(spark, tmp_path):
    """The SQL and the operator agree where most words are long, and where words are only stops."""
    rng = np.random.default_rng(9)
    words = [f"{'long' * 9}{i}" for i in range(150)] + ["--", "...", "short", "W" * 70 + "."]
    rows = [(i, " ".join(rng.choice(words, 70)) + "\n", "en" if i % 3 else "de", "s", 1) for i in range(25)]
    spark.createDataFrame(rows, helpers.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert_same(quality.op5_quality_rules(spark, str(tmp_path)), registry.oracle_sql()["op5_quality_rules"], str(tmp_path))


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(2)
    fast, z, n = toxicity.Ftrl(bits=4), {}, {}

    def weight(i):
        rate = (fast.beta + math.sqrt(n.get(i, 0))) / fast.alpha + fast.l2
        if i == 16:
            return -z.get(i, 0) / rate
        zi = z.get(i, 0)
        return 0.0 if abs(zi) <= fast.l1 else -(zi - math.copysign(fast.l1, zi)) / rate

    for _ in range(400):
        places = np.unique(rng.integers(0, 16, 5).astype(np.int32))
        label = int(3 in places)
        at = [*places.tolist(), 16]
        w = {i: weight(i) for i in at}
        g = (1 / (1 + math.exp(-sum(w.values()))) - label) * (fast.positive if label else 1)
        for i in at:
            before = n.get(i, 0)
            z[i] = z.get(i, 0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / fast.alpha * w[i]
            n[i] = before + g * g
        fast.learn(places, label)
    assert np.allclose(fast.z, [z.get(i, 0) for i in range(17)]) and fast.result().places.size < 16


def plain_places(text, bits=toxicity.BITS):
    """The hashed features of a text, one by one in Python's integers."""
    low = 2**64 - 1
    raw = (text or "").lower().encode(errors="replace")
    hashes = [zlib.crc32(w) for w in bytes(b for b in raw if b not in toxicity.STOPS).split()]
    first, after, skip = (int(x) for x in (toxicity._FIRST, toxicity._NEXT, toxicity._SKIP))
    mixed = [h * first for h in hashes]
    mixed += [a * first + b * after + 1 for a, b in zip(hashes, hashes[1:], strict=False)]
    mixed += [a * first + b * skip + 2 for a, b in zip(hashes, hashes[2:], strict=False)]
    return {((((x & low) ^ ((x & low) >> 29)) * int(toxicity._MIX)) & low) >> (64 - bits) for x in mixed}


def test_toxicity_query_against_a_plain_version(spark, tmp_path):
    """All rows of the query on a small table, learned and scored with dictionaries."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = int(rng.random() < 0.4)
        text = " ".join(rng.choice(words, 25)) + (" you Fool! " * 3 if toxic else " thank you.") + " ".join(rng.choice(words, 5))
        rows.append((i, text, "en", "s", 1))
        labels.append((i, 1, toxic))
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (None, "fool", "en", "s", 1), (7, rows[7][1], "en", "s", 1)]
    labels += [(9, 0, 1), (9, 0, 0), (11, 1, None), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(rows, helpers.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    crc = lambda i: zlib.crc32(str(i).encode())
    known = {}
    for i, _, toxic in labels:
        if i is not None and toxic is not None and crc(i) % 5:
            known[i] = max(known.get(i, 0), toxic)
    texts = {i: t for i, t, *_ in rows if i is not None}
    z, n, model = {}, {}, toxicity.Ftrl(bits=1)

    def weight(i):
        rate = (model.beta + math.sqrt(n.get(i, 0))) / model.alpha + model.l2
        zi = z.get(i, 0.0)
        if i == "bias":
            return -zi / rate
        return 0.0 if abs(zi) <= model.l1 else -(zi - math.copysign(model.l1, zi)) / rate

    for _ in range(toxicity.PASSES):
        for i in sorted((i for i in known if i in texts), key=crc):
            at = [*plain_places(texts[i]), "bias"]
            w = {x: weight(x) for x in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - known[i]) * (model.positive if known[i] else 1)
            for x in at:
                before = n.get(x, 0.0)
                z[x] = z.get(x, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / model.alpha * w[x]
                n[x] = before + g * g
    found = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    assert sum(r["predicted"] for r in found if r["held_out"]) > 15
    for r in found:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "fool"
        score = 1 / (1 + math.exp(-weight("bias") - sum(weight(x) for x in plain_places(text))))
        assert math.isclose(r["score"], score, abs_tol=1e-4)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"]) % 5 == 0)


def test_the_sample_is_bounded_in_features(spark, monkeypatch):
    """Beyond MAX_PLACES the documents of greater id hash aren't learned from; an id is one example."""
    import pyarrow as pa

    batch = pa.record_batch({"doc_id": [1, 2, 3], "toxic": [1, 0, 1], "places": [np.arange(4, dtype=np.int32).tobytes()] * 3})
    full = next(toxicity._learned(iter([batch])))
    monkeypatch.setattr(toxicity, "MAX_PLACES", 8)
    assert next(toxicity._learned(iter([batch]))) == next(toxicity._learned(iter([batch.slice(0, 2)]))) != full
    docs = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "a")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, min("b c", "a", key=lambda t: np.unique(toxicity.features(t)).tobytes()))], "doc_id long, text string")
    assert toxicity.train(docs, labels, F.lit(False)).bias == toxicity.train(one, labels, F.lit(False)).bias


def test_features_are_words_neighbours_and_skips():
    one, two = toxicity.features("Alpha, beta gamma"), toxicity.features("alpha beta. GAMMA!")
    assert one.tolist() == two.tolist() and len(one) == 3 + 2 + 1
    assert len(toxicity.features("a")) == 1 and len(toxicity.features(None)) == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.op6_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r["held_out"]]
    right = [r["predicted"] == r["toxic"] == int(r["score"] >= 0.5) for r in held]
    assert sum(right) >= 0.95 * len(right) and len(held) > 500
    toxic, clean = ([r["score"] for r in held if r["toxic"] == x] for x in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95


def test_toxicity_awkward(spark):
    docs = helpers.awkward(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (15, 0), (12, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs.select("doc_id", "text"), labels, F.lit(False))
    found = toxicity.scored(docs, weights).collect()
    assert len(found) == len(helpers.AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    untaught = toxicity.train(docs.select("doc_id", "text"), labels, F.lit(True))
    assert {r["score"] for r in toxicity.scored(docs, untaught).collect()} == {0.5}
    assert toxicity.scored(helpers.empty(spark), weights).collect() == []
