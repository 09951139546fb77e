"""Operators 6 and 8: held-out accuracy, exact code lengths, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpack.llm import op6_language_id as language
from quillpack.llm import op8_quality as quality

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_held_out(docs):
    odd = F.col("doc_id") % 2 == 1
    model = language.fit(docs.where(odd))
    made = language.identify(docs.where(~odd), model).join(docs, "doc_id").where("n_chars >= 100").collect()
    right = [r.language == r.lang for r in made if r.accepted]
    assert len(right) > 0.9 * len(made) and np.mean(right) >= 0.97


def test_a_long_text_leaves_room_for_the_others(spark):
    lowest = spark.range(40).orderBy(F.xxhash64("id")).first().id
    words = {"a": "the cat sat on the mat and saw that hat", "b": "der hund und die katze sind nicht hier"}
    rows = [(i, "z" * 50_000 if i == lowest else words["ab"[i % 2]] * 5, "ab"[i % 2]) for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_bytes=10_000)
    assert model.languages == ("a", "b")
    raws = [words["a"].encode(), words["b"].encode()]
    assert model.score(raws).argmin(1).tolist() == [0, 1] and (model.score(raws).min(1) < 2 * language.UNIT * np.array([len(r) for r in raws])).all()


def test_room():
    assert language.with_room([10, 5, 1000, 85], 100) == [0, 1, 3] and language.with_room([], 9) == []


def brute_bits(samples, own, raw, least):
    """Bits of a text by the definition, byte by byte, with dictionaries of contexts."""
    from collections import Counter, defaultdict

    counts = {x: defaultdict(Counter) for x in samples}
    total = Counter()
    for x, texts in samples.items():
        for t in texts:
            for i in range(len(t)):
                for order in range(min(i, 3) + 1):
                    counts[x][t[i - order : i]][t[i]] += 1
                    total[t[i - order : i]] += 1
    seen = {b for texts in samples.values() for t in texts for b in t}
    bits = 0.0
    for i, byte in enumerate(raw):
        order = 0
        while order < min(i, 3) and total[raw[i - order - 1 : i]] >= least:
            order += 1
        closed = set()
        while True:
            here = {b: n for b, n in counts[own][raw[i - order : i]].items() if b not in closed}
            n, d = sum(here.values()), len(here)
            if byte in here:
                bits += np.log2((n + d) / here[byte])
                break
            bits += np.log2((n + d) / d) if d else 0
            closed |= set(here)
            if not order:
                bits += np.log2(256 - len(closed))
                break
            order -= 1
    assert seen
    return bits


def test_against_prediction_by_dictionaries():
    samples = {"a": [b"the cat sat on the mat, the hat of that cat", b"a hat, a mat"], "b": ["der hund und die katze saßen dort".encode(), b"und da"], "c": [b"tatata"]}
    for least in (1, 2, 3):
        model = language.build(samples, least)
        for raw in (b"the cat", b"die hand", "ßß xyz".encode(), b"a", b"tata the und", bytes(range(0, 250, 7))):
            got = model.score([raw])[0] / language.UNIT
            assert np.allclose(got, [brute_bits(samples, x, raw, least) for x in "abc"], atol=0.6 * len(raw) / language.UNIT + 1e-6)


FOREIGN = [
    "La nostra vita comincia quando decidiamo di non restare in silenzio davanti alle cose importanti che vediamo ogni giorno in città",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar; akıl ve vicdana sahiptirler",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "q9X/aZ+4kLw0" * 12,
    " ".join(str(i * 7919 % 99991) for i in range(60)),
    "def f(x):\n    return {k: v for k, v in x.items() if k > 3 and v[0] != 'q'}\n" * 3,
]


def test_what_is_rejected(docs, documents):
    """Other languages, code, digits and encoded bytes go; of the documents themselves hardly any does."""
    model = language.fit(docs)
    assert not [r for r in language.identify(documents(*enumerate(FOREIGN)), model).where("accepted").collect()]
    kept = language.accepted_documents(docs, model).count()
    assert kept >= 0.99 * docs.count()


def test_accepted_in_slices(spark, docs, documents):
    """Texts of several slices in one partition, one longer than a slice, are judged as each is alone."""
    model = language.fit(docs)
    held = [r.text for r in docs.select("text").where("text is not null").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate([None, "", "xq zj" * 300_000, held[0] * (1 + 1_200_000 // len(held[0])), *held, *[x * 20 for x in held], "0x7f " * 40, " "])]
    alone = {i for i, t in rows if language._judged(model, [t], language.REJECT_BITS, language.SLACK_BITS)[3][0]}
    made = language.accepted_rows(documents(*rows).coalesce(1), model)
    assert {r.doc_id for r in made.collect()} == alone and 40 < len(alone) < len(rows) - 3
    assert language.accepted_rows(documents(*rows).where("false"), model).count() == 0


def test_code_lengths_are_those_of_a_distribution():
    model = language.build({"a": [b"the cat sat on the mat, the hat"] * 3, "b": [b"der hund und die katze"] * 3})
    k = int(model.symbol[language.PAD]) + 1
    bits = model.bits.reshape(-1, k, 2) / language.UNIT
    total = (2.0 ** -bits[:, :-1]).sum(1) + 2.0 ** -bits[:, -1] * (256 - (k - 1))
    assert np.allclose(total, 1, atol=0.02)


def test_code_length_of_a_text_is_the_sum_over_its_bytes():
    model = language.build({"a": [b"banana bandana"] * 4, "b": [b"other words"] * 4})
    raws = [b"banana", b"", b"xyz", b"ban other"]
    k = int(model.symbol[language.PAD]) + 1
    for raw, got in zip(raws, model.score(raws)):
        padded = bytes([language.PAD]) * 3 + raw
        total = np.zeros(2, np.int64)
        for i in range(3, len(padded)):
            a, b, c = (int(model.symbol[padded[i - j]]) for j in (1, 2, 3))
            total += model.bits[model.context[(a * k + b) * k + c] * k + int(model.symbol[padded[i]])]
        assert got.tolist() == total.tolist()


def test_language_edges(docs, documents):
    model = language.fit(docs)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the of and with"), (4, "the of and with"), (None, "le la des"), (5, "\x00\x01" * 400), (6, docs.first().text * 50)]
    made = sorted(((r.doc_id, r.accepted, r.language) for r in language.identify(documents(*rows), model).collect()), key=repr)
    assert [x[:2] for x in made] == [(1, False), (2, False), (3, False), (4, True), (4, True), (5, False), (6, True), (None, True)]
    assert [x[2] for x in made[:3]] == [None] * 3
    assert language.accepted_rows(documents(*rows), model).columns == documents().columns
    assert language.accepted_rows(documents(*rows), model).count() == 4
    nothing = language.fit(documents((1, None)))
    assert nothing is None and language.accepted_rows(documents(*rows), nothing).count() == 0
    assert language.identify(documents(), model).collect() == []


def test_quality_held_out(spark):
    """On some 3,000 labels; the 300 of the smaller scale are too few to tell rare words apart (0.83 there)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("doc_id % 4 <> 0")
    model = quality.fit(docs, known)
    assert model.thresholds[0] < model.thresholds[1]
    made = quality.scored(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").where("has_text").collect()
    good = [r.p_ge_2 for r in made if r.quality == 1 and not r.toxic]
    rest = [r.p_ge_2 for r in made if r.quality == 0 or r.toxic]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in rest]) >= 0.95
    assert all(r.p_ge_1 >= r.p_ge_2 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-9 for r in made)


def test_slopes_are_derivatives():
    rng = np.random.default_rng(1)
    s, y, h = rng.standard_normal(60) * 3, rng.integers(0, 3, 60), 1e-6

    def loss(s, low, high):
        upper = [1 / (1 + np.exp(low - s)), 1 / (1 + np.exp(high - s))]
        return -np.log(np.choose(y, [1 - upper[0], upper[0] - upper[1], upper[1]]))

    one, two = quality.slopes(s, -0.5, 1.2, y)
    assert np.allclose(one + two, (loss(s + h, -0.5, 1.2) - loss(s - h, -0.5, 1.2)) / (2 * h), atol=1e-5)
    assert np.allclose(-one, (loss(s, -0.5 + h, 1.2) - loss(s, -0.5 - h, 1.2)) / (2 * h), atol=1e-5)
    assert np.allclose(-two, (loss(s, -0.5, 1.2 + h) - loss(s, -0.5, 1.2 - h)) / (2 * h), atol=1e-5)


def plain_features(text):
    """The features of a text one by one."""
    import regex

    from quillpack.llm import words

    one = lambda x: words.span_hashes(words.codes_of([x])[0], np.array([0]), np.array([len(x)]))[0]
    mixed = lambda x: words.mixed(np.full(1, x, np.uint64))[0]
    found = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    symbols = regex.findall(r"[^\p{L}\p{N}\s]+", text)
    made = {one(w) for w in found} | {one(w[:k]) ^ mixed(k) for w in found for k in quality.PREFIXES if len(w) > k} | {one(x) ^ np.uint64(0x5555555555555555) for x in symbols}
    share = lambda a, b: min(9, 10 * a // max(b, 1))
    n, size = len(found), min(12, int(np.log2(max(len(found), 1))))
    letters, caps = len(regex.findall(r"\p{L}", text)), sum(a != b for a, b in zip(text, text.lower()))
    shape = [share(len(set(found)), n) + 16 * size + 1000, share(caps, letters) + 2000, share(len(symbols), n) + 3000, size + 4000, share(sum(len(x) > 1 for x in symbols), n) + 5000, share(sum(a == b for a, b in zip(found, found[1:])), n) + 6000]
    return sorted({int(x >> np.uint64(64 - quality.HASH_BITS)) for x in made | {mixed(x + (1 << 40)) for x in shape}})


def test_query_against_scores_one_by_one(spark, docs):
    few = docs.where("doc_id % 40 = 3")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {}
    for r in few.collect():
        score = sum(model.weights[x] for x in plain_features(r.text))
        tails = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        if tails[1] >= quality.KEEP:
            want[r.doc_id] = (sum(tails), *tails)
    made = {r.doc_id: (r.expected_grade, r.p_ge_1, r.p_ge_2) for r in quality.selected(few, model).collect()}
    assert set(made) == set(want) and want and all(np.allclose(made[i], want[i], atol=2e-6) for i in want)


def test_quality_learns_a_grade_from_ordered_words():
    texts = [f"{w} filler{i % 7} text" for i in range(300) for w in (("bad", "fair", "good")[i % 3],)]
    of, feature = quality.features(texts)
    model = quality.learn(of, feature, np.array([i % 3 for i in range(300)]))
    tails = model.tails(["bad text", "fair text", "good text"])
    assert tails.sum(1).round().tolist() == [0, 1, 2]


def test_quality_edges(spark, docs, documents):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (2, None, 0, "x"), (None, 1, 1, "x"), (77, 1, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    rows = [(1, "words here"), (2, None), (3, ""), (4, " "), (5, "many words " * 20_000), (5, "many words"), (None, "words")]
    model = quality.fit(documents(*rows), labels)
    made = quality.scored(documents(*rows), model).collect()
    assert len(made) == len(rows)
    assert sorted((repr(r.doc_id), r.expected_grade is None) for r in made) == sorted((repr(i), not (t or "").strip()) for i, t in rows)
    assert quality.fit(documents(*rows), labels.limit(0)) is None
    assert sorted((r.doc_id for r in quality.selected(documents(*rows), None).collect()), key=repr) == [1, 5, 5, None]
    assert quality.scored(documents(), model).collect() == []


def test_queries(spark, docs):
    n = docs.count()
    assert 0.5 * n < language.op6_language_id(spark, DATA).count() <= n
    assert 0 < quality.op8_quality(spark, DATA).count() < n
