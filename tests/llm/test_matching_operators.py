"""Operators 1, 2, 5, 7 and 9 against brute force, and the pipeline."""

import math
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillpack.llm import groups
from quillpack.llm import op1_pii as pii
from quillpack.llm import op2_decontamination as leaks
from quillpack.llm import op5_embedding_dedup as vectors
from quillpack.llm import op6_language_id as language
from quillpack.llm import op7_simhash_dedup as simhash
from quillpack.llm import op9_line_dedup as lines
from quillpack.llm import op10_bpe_codec as codec
from quillpack.llm import registry

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def sql(query):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    made = con.execute(query)
    return {x[0]: i for i, x in enumerate(made.description)}, made.fetchall()


@pytest.mark.parametrize("name", ["op2_decontamination", "op5_embedding_dedup", "planted_vectors", "op9_line_dedup"])
def test_sql(spark, name):
    made = registry.queries()[name](spark, DATA)
    at, rows = sql(registry.oracle_sql()[name])
    assert sorted(at) == sorted(made.columns) and rows
    assert sorted(map(tuple, made.select(*at).collect()), key=repr) == sorted(rows, key=repr)


# 1


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail a.b+c@ex-ample.co.uk, ok", [("email", "a.b+c@ex-ample.co.uk")]),
        ("not@mail, @home a@b", []),
        ("see https://ex.org/a?b=1. Then", [("url", "https://ex.org/a?b=1")]),
        ("host 10.0.255.1 and 10.0.256.1, v 1.2.3.4.5", [("ip", "10.0.255.1")]),
        ("v6 2001:db8::1 here", [("ip", "2001:db8::1")]),
        ("card 4111 1111 1111 1111, 4111 1111 1111 1112", [("card", "4111 1111 1111 1111")]),
        ("iban GB82 WEST 1234 5698 7654 32.", [("iban", "GB82 WEST 1234 5698 7654 32")]),
        ("iban GB83 WEST 1234 5698 7654 32.", []),
        ("ssn 123-45-6789; not 000-45-6789", [("ssn", "123-45-6789")]),
        ("call +1 415-555-0132 or (415) 555-0199", [("phone", "+1 415-555-0132"), ("phone", "(415) 555-0199")]),
        ("account number: 123456789", [("account", "123456789")]),
        ('password = "hunter2hunter2"', [("secret", 'password = "hunter2hunter2"')]),
        ("in 1999 there were 12 of 3,400 and 2024-01-31", []),
        ("", []),
    ],
)
def test_personal_data(text, found):
    assert [(k, text[a:b]) for a, b, k in pii.spans(text) if k != "secret" or "=" in text] == found


def test_personal_data_by_rows(documents):
    rows = [(1, None), (2, ""), (3, "a@b.org"), (3, "a@b.org"), (None, "a@b.org"), (4, "word " * 50_000 + "a@b.org")]
    made = sorted((repr(r.doc_id), r.start, r.value) for r in pii.find(documents(*rows)).collect())
    assert made == [("3", 0, "a@b.org"), ("3", 0, "a@b.org"), ("4", 250_000, "a@b.org"), ("None", 0, "a@b.org")]
    assert {r.doc_id: r.text for r in pii.redact(documents(*rows)).collect()}[3] == "[EMAIL]"
    assert pii.find(documents()).collect() == []


def test_anchors_miss_no_address(spark):
    """Every address that a plain pattern finds lies in a span."""
    import re

    plain = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        spans = pii.spans(r.text)
        for m in plain.finditer(r.text):
            assert any(a < m.end() and m.start() < b for a, b, _ in spans), m[0]


# 2


def test_decontamination(spark, documents):
    item, other = prose(1, 40), prose(2, 30)
    items = spark.createDataFrame([(1, item, 9), (2, other, 9), (3, None, 9), (4, "two words", 9), (None, other, 9)], "item_id bigint, text string, doc_id int")
    rows = [(10, prose(5, 500) + " " + item + " " + prose(6, 300)), (11, item.upper().replace(" ", ", ")), (12, prose(7, 900)), (13, " ".join(item.split()[:15])), (14, None), (15, ""), (11, item.upper().replace(" ", ", ")), (None, item), (16, prose(8, 60_000) + " " + other)]
    made = {(r.doc_id, r.item_id): r.containment for r in leaks.contaminated(documents(*rows), items).collect()}
    assert made == {(10, 1): 1.0, (11, 1): 1.0, (None, 1): 1.0, (16, 2): 1.0, (16, None): 1.0}
    joined = {(r.doc_id, r.item_id): r.containment for r in leaks.contaminated(documents(*rows), items, broadcast_shingles=0).collect()}
    assert joined == made
    assert sorted(r.doc_id for r in leaks.clean(documents(*rows), items).collect()) == [12, 13, 14, 15]
    assert leaks.contaminated(documents(), items).collect() == [] and leaks.contaminated(documents(*rows), items.limit(0)).collect() == []


def test_decontamination_tells_texts_of_one_id_apart(spark, documents):
    item = prose(1, 40)
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    bad, fine = [item, item + " " + prose(3, 20)], [prose(7, 90), None]
    rows = [(i, t) for i in (None, 5) for t in bad + fine]
    assert sorted(((r.doc_id, r.text) for r in leaks.clean(documents(*rows), items).collect()), key=repr) == sorted(((i, t) for i in (None, 5) for t in fine), key=repr)
    assert sorted((repr(r.doc_id), r.item_id, r.containment) for r in leaks.contaminated(documents(*rows), items).collect()) == [("5", 1, 1.0)] * 2 + [("None", 1, 1.0)] * 2


# 5


def test_lattice(spark):
    y = np.random.default_rng(1).standard_normal((300, 8)) * 2
    p = vectors.nearest(y)
    assert ((np.abs(p - np.rint(p)).max(1) < 1e-9) | (np.abs(p - np.floor(p) - 0.5).max(1) < 1e-9)).all()
    assert (np.rint(p.sum(1)) % 2 == 0).all()
    best = ((y - p) ** 2).sum(1)
    for v in vectors.minimal():
        assert (((y - p - v) ** 2).sum(1) >= best - 1e-9).all()


def brute_vectors(rows, threshold=vectors.THRESHOLD):
    """(vec_id, class_id, n_links) of each row (vec_id, vector), by comparing all."""
    rows = sorted({(i, None if v is None else tuple(np.array(v, np.float32).tolist())) for i, v in rows if i is not None}, key=repr)
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    near = {k: set() for k in range(len(rows))}
    for a, b in combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if fine(x) and fine(y) and len(x) == len(y) and np.dot(x, y) / (math.sqrt(np.dot(x, x)) * math.sqrt(np.dot(y, y))) >= threshold:
            near[a].add(b)
            near[b].add(a)
    out = []
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((rows[k][0], min(rows[x][0] for x in seen), len(near[k])))
    return sorted(out)


def triples(made):
    return sorted((r.vec_id, r.class_id, r.n_links) for r in made.collect())


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 32))
    every = np.concatenate([base, base[:30] + rng.standard_normal((30, 32)) * 0.15, base[5] + rng.standard_normal((40, 32)) * 0.1])
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(every)] + [(900, None, 1, 2), (901, [], 1, 2), (902, [0.0] * 32, 1, 2), (903, [float("nan")] * 32, 1, 2), (907, [float("nan")] * 32, 1, 2), (908, [None] * 32, 1, 2), (904, every[0].tolist(), 1, 2), (0, every[0].tolist(), 1, 2), (None, every[1].tolist(), 1, 2), (905, [1.0, 2.0], 1, 2), (906, [2.0, 4.0], 1, 2), (906, [3.0, -1.0], 1, 2), (906, [1e-30, 2e-30], 1, 2), (909, (every[3] * 1e30).tolist(), 1, 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, key int, n int")
    want = brute_vectors([r[:2] for r in rows])
    assert triples(vectors.near_vectors(df)) == want and max(n for _, _, n in want) > 30
    # Groups and cells cut into many small blocks give the same.
    assert triples(vectors.near_vectors(df, block=7)) == want
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_copies_of_one_vector(spark):
    """A third of all rows are one vector; they stay one class."""
    rng = np.random.default_rng(5)
    one, other = rng.standard_normal((2, 16)).tolist()
    rows = [(i, one) for i in range(500)] + [(500, other)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(900)]
    made = triples(vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")))
    assert made[:501] == [(i, 0, 499) for i in range(500)] + [(500, 500, 0)]


def test_recall_at_the_threshold():
    """Pairs whose cosine is exactly the threshold, or a little more, meet in some table."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, y = unit(rng.standard_normal((2000, 64))), rng.standard_normal((2000, 64))
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    for cosine, least in ((vectors.THRESHOLD, 0.98), (0.97, 0.997)):
        z, met = cosine * x + math.sqrt(1 - cosine * cosine) * y, np.zeros(2000, bool)
        for t in range(vectors.TABLES):
            (a, pa), (b, pb) = vectors.keys(x, t), vectors.keys(z, t)
            met |= (a == b) | (pa == b[:, None]).any(1) | (pb == a[:, None]).any(1)
        assert met.mean() >= least


@pytest.mark.parametrize("seed", range(5))
def test_labels_and_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([10, 30, 50]))] + ([(i, i + 1) for i in range(40)] if seed == 4 else [])
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    a, b = np.array(pairs).T
    assert groups.labels(n, a, b).tolist() == root
    made = {r.id.k: r.root.k for r in groups.components(spark.createDataFrame([((x,), (y,)) for x, y in pairs], "x struct<k:int>, y struct<k:int>")).collect()}
    assert made == {i: root[i] for x, y in pairs if x != y for i in (x, y)}


# 7


def groups_of(prints, radius):
    root = {i: i for i in range(len(prints))}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if sum(int(x).bit_count() for x in prints[a] ^ prints[b]) <= radius:
            root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(prints))]


def brute_left(rows, originals):
    """Positions of rows (doc_id, text), cut from originals by id, that near_dedup keeps."""
    left = sorted(brute_kept([(i, originals[i]) for i, _ in rows]))
    again = brute_kept([rows[i] for i in left])
    return {left[i] for i in again}


def brute_kept(rows):
    """Positions of rows (doc_id, text) of which nothing near and earlier stays."""
    out, some = simhash.fingerprints([t or "" for _, t in rows])
    held = sorted((i for i in range(len(rows)) if some[i]), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    root = groups_of(out[held], simhash.RADIUS)
    return {held[i] for i, r in enumerate(root) if r == i} | {i for i in range(len(rows)) if not some[i]}


def test_simhash(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    made = {r.doc_id: r.kept_doc_id for r in simhash.op7_simhash_dedup(spark, DATA).collect()}
    kept = brute_kept(rows)
    assert {i for i, _ in rows} - {d for d, k in made.items() if d != k} == {rows[i][0] for i in kept}


def test_simhash_edges(documents):
    long = prose(1, 400)
    rows = [(5, long), (3, long + " end"), (9, long), (9, long), (7, None), (8, ""), (6, "!!"), (1, prose(2, 400)), (None, long), (2, "word"), (4, "word"), (11, prose(3, 60_000))]
    kept = [r.doc_id for r in simhash.one_of_each(documents(*rows)).collect()]
    assert sorted(kept, key=repr) == [1, 11, 2, 3, 6, 7, 8]
    assert simhash.one_of_each(documents(*rows)).columns == documents().columns
    assert simhash.near_duplicates(documents()).collect() == [] and simhash.one_of_each(documents()).collect() == []
    repeats = documents((1, None), (1, None), (2, "a b"), (2, "a b"))
    assert sorted(r.doc_id for r in simhash.one_of_each(repeats).collect()) == [1, 2]


def test_near_copies_by_shared_runs(documents):
    """Copies with one word in twenty changed, held against the share of common three-word runs, not the fingerprints."""
    rng = random.Random(8)
    known = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(120):
        text = rng.choices(known, k=200)
        copy = [rng.choice(known) if rng.random() < 0.05 else w for w in text]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    runs = {i: set(zip(w, w[1:], w[2:])) for i, t in rows for w in [t.split()]}
    want = {(a, b) for a, b in combinations(sorted(runs), 2) if len(runs[a] & runs[b]) >= 0.5 * len(runs[a] | runs[b])}
    made = {(r.kept_doc_id, r.doc_id) for r in simhash.near_duplicates(documents(*rows)).collect() if r.doc_id != r.kept_doc_id}
    assert len(want) > 100 and len(made & want) >= 0.97 * len(want) and all(b == a + 1 and a % 2 == 0 for a, b in made)


def test_tiles(spark):
    """Many small tiles give what one gives."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)
    x = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 60, (40, 2), dtype=np.uint64))])
    rows = [(int(a), int(b), i + 1) for i, (a, b) in enumerate(x.view(np.int64).tolist())]
    number = {r[:2]: i for i, r in enumerate(rows)}
    df = spark.createDataFrame(rows, "f bigint, g bigint, n bigint")
    for size in (3, 1000):
        made = simhash.near_edges(df, 8, size).collect()
        assert {frozenset((number[r.f, r.g], number[r.rf, r.rg])) for r in made} - {frozenset((i,)) for i in range(80)} == {frozenset((i, i + 40)) for i in range(40)}
        assert {number[r.f, r.g]: r.links for r in made} == {i: (i + 40) % 80 + 1 for i in range(80)}


def by_bit_count(x):
    return np.ascontiguousarray(x[np.argsort(np.bitwise_count(x).sum(1), kind="stable")])


def test_bands_find_all_near_pairs(monkeypatch):
    """Near pairs by bands are those of a full comparison, each once, of random prints with copies and of prints alike in some bits."""
    monkeypatch.setattr(simhash, "FEW_CELLS", 0)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, (900, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (900, 2), dtype=np.uint64)
    copies = base.copy()
    for row in range(900):
        for bit in rng.choice(128, rng.integers(1, 36), replace=False):
            copies[row, bit // 64] ^= np.uint64(1 << (int(bit) % 64))
    a = by_bit_count(np.concatenate([base, copies[:600]]))
    b = by_bit_count(copies)
    alike = by_bit_count(np.unique(base & np.array([0xFFFF, 0xFF0000FF], np.uint64), axis=0))
    for per_value in (0, simhash.PER_BUCKET):  # wider and narrower bands
        monkeypatch.setattr(simhash, "PER_BUCKET", per_value)
        simhash.bands_of.cache_clear()
        for x, y, same in ((a, a, True), (a, b, False), (b, a, False), (alike, alike, True)):
            d = sum(np.bitwise_count(x[:, k, None] ^ y[None, :, k]).astype(int) for k in (0, 1))
            for radius in (28, 8):
                want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius)) if i < j or not same}
                for shares in (1, 3):
                    made = [p for share in range(shares) for i, j in simhash.blocks(x, y, radius, same, share, shares) for p in zip(i.tolist(), j.tolist())]
                    assert len(made) == len(set(made)) and set(made) == want
    simhash.bands_of.cache_clear()


def test_bands_spare_comparisons(monkeypatch):
    """Of 60,000 random prints less than a third of all pairs are compared; a full comparison counts the bits of each twice."""
    counted = 0

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def bitwise_count(self, x, **more):
            nonlocal counted
            counted += x.size
            return np.bitwise_count(x, **more)

    rng = np.random.default_rng(12)
    x = by_bit_count(rng.integers(0, 1 << 63, (60_000, 2), dtype=np.uint64))
    monkeypatch.setattr(simhash, "np", Counting())
    assert sum(len(i) for i, _ in simhash.blocks(x, x, 28, True)) <= 2  # unrelated ones meet with probability 5e-11
    assert counted < 2 * (len(x) * (len(x) - 1) // 2) / 3


def test_links(documents):
    """Copies, and many different texts that are all near each other: a class, and every link counted."""
    text = prose(9, 300).split()
    near = [" ".join([*text[:i], "other", *text[i + 1 :]]) for i in range(0, 300, 5)]
    rows = [(i, t) for i, t in enumerate([*near, near[0], near[0], prose(10, 300), "one more"])]
    made = {r.doc_id: (r.kept_doc_id, r.n_links) for r in simhash.near_duplicates(documents(*rows)).collect()}
    prints = simhash.fingerprints([t for _, t in rows])[0]
    count = lambda i: sum(i != j and sum(int(x).bit_count() for x in prints[i] ^ prints[j]) <= simhash.RADIUS for j in range(len(rows)))
    assert made == {i: (0, count(i)) for i in range(62)} and all(n > 50 for _, n in made.values())


def test_cut_copies_are_known_by_their_originals(documents):
    """Copies of which lines were cut go by what they were cut from; rows that weren't cut from it don't."""
    one = [prose(i, 30) for i in range(20, 40)]
    whole = [(1, "\n".join(one)), (2, "\n".join([*one[:19], one[19] + " changed"])), (3, "\n".join(one)), (4, prose(5, 200)), (None, "\n".join(one))]
    docs = documents((1, "\n".join(one)), (2, one[19] + " changed"), (3, "another text altogether"), (4, prose(5, 200)), (None, one[2]), (6, "no original"), (7, None))
    assert sorted((r.doc_id for r in simhash.one_of_each(docs, documents(*whole)).collect()), key=repr) == [1, 3, 4, 6, 7, None]
    assert simhash.one_of_each(docs, documents()).count() == 7 and simhash.one_of_each(documents(), documents(*whole)).count() == 0


# 9


def test_banded_distances():
    random.seed(6)
    left, right = [], []
    for _ in range(600):
        a = [random.choice("abcé ") for _ in range(random.randint(0, 60))]
        b = a.copy()
        for _ in range(random.randint(0, 4)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 1)] = random.choices("abcx", k=random.randint(0, 1))
        left.append("".join(a))
        right.append("".join(b))
    for k in (1, 2, 3):
        assert lines.banded(left, right, k).tolist() == [min(lines._plain(a, b), k + 1) for a, b in zip(left, right)]


def brute_lines(rows, least=lines.LEAST_CHARS, threshold=lines.THRESHOLD):
    """(doc_id, line_no) of dropped lines, by comparing all."""
    held = sorted(((i is None, i or 0, n, x, i) for i, t in rows for n, x in enumerate(lines.lines_of(t or "")) if x), key=lambda x: x[:3])
    gone = set()
    for at, (_, _, n, x, i) in enumerate(held):
        for _, _, m, y, j in held[:at]:
            if (j, m) != (i, n) and (x == y or min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= threshold and lines._plain(*lines.core(x, y)) <= threshold):
                gone.add((i, n))
                break
    return gone


def test_lines(documents):
    one = "The first line of some length, repeated with slips."
    rows = [(1, f"{one}\n\nshort\nown line number one\n{one[:-2]}s!"), (2, f"  {one.replace('some', 'soe')}\nshort\n"), (3, None), (4, ""), (4, ""), (None, one + "\nlast one of all"), (5, prose(1, 30_000) + "\n" + one), (6, one.replace("first", "fixed")), (7, "ünïcödé " * 6), (8, "ünïcödé " * 5 + "unïcödé ")]
    made = {(r.doc_id, r.line_no) for r in lines.dropped_lines(documents(*rows)).collect()}
    assert made == brute_lines(rows) and (8, 0) in made and (6, 0) not in made
    again = {(r.doc_id, r.line_no) for r in lines.dropped_lines(documents(*rows), broadcast_lines=0).collect()}
    assert again == made
    kept = {r.doc_id: r.text for r in lines.without_repeats(documents(*rows)).collect()}
    assert set(kept) == {1, 3, 4, 5, None, 6, 7} and kept[None] == "last one of all" and kept[3] is None
    assert lines.without_repeats(documents(*rows)).columns == documents().columns
    assert lines.dropped_lines(documents()).collect() == [] and lines.without_repeats(documents()).collect() == []


def test_many_lines_of_one_group(documents):
    """Hundreds of different lines that all meet in one segment, and one line that a third of all rows have."""
    rng = random.Random(13)
    lines_ = [f"One line of a large group, of which this is number {i:03d} of all." for i in range(300)]
    rows = [(i, x) for i, x in enumerate(lines_)] + [(1000 + i, "the line that everyone repeats, word for word") for i in range(250)] + [(2000 + i, prose(i, 12)) for i in range(150)]
    rng.shuffle(rows)
    made = {(r.doc_id, r.line_no) for r in lines.dropped_lines(documents(*rows)).collect()}
    assert made == brute_lines(rows) and len(made) > 500


# The pipeline


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A hundred documents, their copies, and one that holds a benchmark item."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 100 and n_chars < 4000")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.first().text
    row = docs.first()
    rest = [(1000, item, row.lang, "x", 1), (1001, row.text.replace("\n", " ") + " more", row.lang, "x", 1), (1002, None, "en", "x", 0), (1003, "", "en", "x", 0), (1004, "¶÷×" * 200, None, "x", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(spark.createDataFrame(rest, docs.schema)).withColumn("extra", F.lit(1)).drop("extra").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fine = {r.doc_id for r in language.identify(docs, language.fit(docs)).where("accepted").collect()}
    assert not fine & {1002, 1003, 1004} and len(fine) > 0.9 * len(rows) - 3
    rows = [(i, t) for i, t in rows if i in fine]
    gone = brute_lines(rows)
    cut = []
    for i, t in rows:
        left = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
        if len(left) == len(t.split("\n")) or "".join(left).strip():
            cut.append((i, "\n".join(left)))
    cut = [cut[i] for i in sorted(brute_left(cut, dict(rows)))]
    bad = set()
    shingled = lambda t: [tuple(w[i : i + 3]) for w in [words_of(t)] for i in range(len(w) - 2)]
    for item in items.collect():
        want = set(shingled(item.text))
        size = len(shingled(item.text))
        for i, t in cut:
            have = [x if x in want else None for x in shingled(t)]
            if len(want & set(have)) >= 0.6 * len(want) - 1e-9 and any(len(set(have[a : a + size]) - {None}) >= 0.6 * len(want) - 1e-9 for a in range(len(have))):
                bad.add(i)
    want = {i: t for i, t in cut if i not in bad}
    made = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in made} == set(want)
    assert {r.doc_id: r.text for r in codec.decode(spark.createDataFrame(made)).collect()} == want


def words_of(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def test_stages_keep_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "benchmark_decontamination", "bpe_codec"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0
