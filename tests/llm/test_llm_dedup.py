"""SimHash, line and substring dedup against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from llm_fixtures import SCHEMA, Groups, lower, split
from pyspark.sql import functions as F

from epiwatch.llm.common import components, linked
from epiwatch.llm import line_dedup as line_module
from epiwatch.llm.line_dedup import alike, block_masks, line_dedup, op7_line_dedup, removals, simhashes
from epiwatch.llm.simhash_dedup import covering_masks, fingerprint, near_duplicates, one_of_each
from epiwatch.llm.substring_dedup import substring_dedup


def brute_fingerprint(text: str | None, shingle: int = 3) -> int:
    w = split(lower(text))
    shingles = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_pair_within_the_radius_meets():
    for radius in (1, 2, 3):
        masks = covering_masks(radius)
        for bits in combinations(range(64), radius):
            apart = sum(1 << b for b in bits)
            assert any(apart & m == 0 for m in masks)
    for radius, keep in ((1, 1), (2, 2), (3, 2)):
        for bits in combinations(range(64), radius):
            assert any(sum(1 << b for b in bits) & m == 0 for m in block_masks(radius, keep))


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(7, 7)]
    edges += [(r.randint(300, 340), r.randint(300, 340)) for _ in range(25)]
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    for a, b in combinations(got, 2):
        assert (got[a] == got[b]) == (g.find(a) == g.find(b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_is_exact_in_a_hot_bucket(spark):
    """One bucket, in which pivots reach few: the rest is found by comparison."""
    r = random.Random(2)
    ids = r.sample(range(1, 3000), 300)
    df = spark.createDataFrame([(1, i, 1) for i in ids] + [(2, i, 1) for i in ids[:9]] + [(3, 5000, 1)], "bucket long, id long, n long")
    got = {x.node: x.root for x in linked(df, F.abs(F.col("l.id") - F.col("r.id")) <= 9, F.col("n")).collect()}
    g = Groups()
    for a, b in combinations(ids, 2):
        if abs(a - b) <= 9:
            g.join(a, b)
    for a, b in combinations(ids, 2):
        assert (got.get(a, a) == got.get(b, b)) == (g.find(a) == g.find(b))
    assert 5000 not in got


@pytest.fixture(scope="module")
def near(rows):
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    g = Groups()
    for _, x in fps:
        for _, y in fps:
            if (x ^ y).bit_count() <= 3:
                g.join(x, y)
    least = {}
    for i, x in fps:
        if i is not None:
            least[g.find(x)] = min(i, least.get(g.find(x), i))
    return fps, g, least


def test_near_duplicates(docs, rows, no_docs, near):
    fps, g, least = near
    want = Counter((i, x, least.get(g.find(x))) for i, x in fps)
    assert Counter((x.doc_id, x.fp % 2**64, x.component_id) for x in near_duplicates(docs).collect()) == want
    assert near_duplicates(no_docs).count() == 0
    assert fingerprint("") == 0


def test_one_of_each(docs, rows, near):
    fps, g, least = near
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(least.values())


def words_of_line(raw: str) -> list[str]:
    return split(raw.lower())


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_simhash_of_lines(spark):
    lines = ["a b c", "x", " ".join(["one two"] * 100), " ".join(f"w{i % 90}" for i in range(600)), "é, (ß) 🙂!", "... ;", " ".join(str(i) for i in range(40_000))]
    lines += [" ".join(f"v{i}" for i in range(n)) for width in line_module.WIDTHS for n in (line_module.most_words(width) + k for k in (-1, 0, 1))]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    found = {x.k: x.fp for x in simhashes(df, ["k"]).collect()}
    assert sorted(found) == list(range(len(lines)))
    plain = spark.createDataFrame([(k, re.sub("[.,;:!?\"'()]", "", x)) for k, x in enumerate(lines)], "k long, line string")
    for x in plain.select("k", F.transform(F.array_distinct(F.split("line", " ")), lambda w: F.xxhash64(w)).alias("h")).collect():
        h = [v % 2**64 for v in x.h]
        assert found[x.k] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_counts_words_by_sevens(spark):
    """Every number of words beside a multiple of seven, with words repeated and words that are
    empty without their stops; lines are split in two passes, of which one is for very long ones."""
    r = random.Random(21)
    lines = [" ".join(f"{r.choice('abc')}{i}" for i in range(n)) for n in [*range(1, 31), *range(60, 72), *range(125, 129), 255, 256, 257]]
    lines += [" ".join(r.choice(["a", "b,", "c.d", "...", "(e)", "é"]) for _ in range(n)) for n in range(1, 40)]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    prints = simhashes(df, ["k"])
    found = {x.k: x.fp % 2**64 for x in prints.collect()}
    words = [(k, sorted({re.sub("[.,;:!?\"'()]", "", w) for w in x.split(" ")})) for k, x in enumerate(lines)]
    for x in spark.createDataFrame(words, "k long, w array<string>").select("k", F.transform("w", lambda w: F.xxhash64(w)).alias("h")).collect():
        assert found[x.k] == sum(1 << b for b in range(64) if 2 * sum((v % 2**64) >> b & 1 for v in x.h) > len(x.h))
    plan = prints._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") <= 2
    assert "translate(" not in plan


def test_lines_are_made_once(spark):
    """White space of all kinds at all places, and the plan lower-cases a line at one place."""
    blank = [" ", "\t", "\x0b", "\x0c", "\r", "  ", " \t ", "\r\x0b"]
    texts = [f"{a}One{b}TWO thrée{c}" for a in ["", *blank] for b in blank for c in ["", *blank]] + [*blank, "", "\u00a0", "\u2003x", "\n\n", None]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA)
    lines = line_module.lines_of(docs)
    want = [(k, i, " ".join(words_of_line(x))) for k, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if words_of_line(x)]
    assert sorted((x.doc, x.pos, x.line) for x in lines.collect()) == want
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_alike_is_the_edit_similarity(spark):
    r = random.Random(8)
    rows = []
    for i in range(300):
        w = ["".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))]
        v = list(w)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(v))
            v[at:at + 1] = r.choice([[], [r.choice("xyz") * r.randint(1, 5)], [v[at], "q"]])
            v = v or ["z"]
        rows.append((i, " ".join(w), " ".join(v)))
    got = {x.i: x.ok for x in spark.createDataFrame(rows, "i long, x string, y string").select("i", alike("x", "y", 0.8).alias("ok")).collect()}
    want = {i: edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for i, x, y in rows}
    assert got == want
    assert 50 < sum(want.values()) < 250


@pytest.mark.parametrize("bits", [2**15, 2**26])
def test_filter_over_wanted_lines_is_exact(spark, monkeypatch, bits):
    monkeypatch.setattr(line_module, "FILTER_BITS", bits)
    lines = spark.range(-5000, 5000).select((F.col("id") * 7919).alias("id"), F.col("id").alias("line"))
    wanted = spark.range(-900, 3000, 3).select((F.col("id") * 7919).alias("id"))
    got = sorted(x.id for x in line_module._those_of(lines, wanted).collect())
    assert got == [i * 7919 for i in range(-900, 3000, 3)]


def brute_removals(spark, rows) -> dict:
    places = defaultdict(list)
    for i, t in sorted({(2**63 - 1 if i is None else i, t) for i, t, *_ in rows if t}):
        for k, raw in enumerate(t.split("\n")):
            if words_of_line(raw):
                places[" ".join(words_of_line(raw))].append((i, k, t))
    lines = [x for x in places]
    fps = {x.k: x.fp % 2**64 for x in simhashes(spark.createDataFrame([(x, x) for x in lines], "k string, line string"), ["k"]).collect()}
    g = Groups()
    for a, b in combinations(lines, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2 and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            g.join(a, b)
    groups = defaultdict(list)
    for x in lines:
        groups[g.find(x)] += places[x]
    gone = defaultdict(set)
    for at in groups.values():
        for i, k, t in sorted(at)[1:]:
            gone[i, t].add(k)
    return gone


def line_rows():
    r = random.Random(9)
    some = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 9)) for _ in range(r.randint(3, 40))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(some)
            if r.random() < 0.5:
                w = x.split()
                w[r.randrange(len(w))] += r.choice("sx")
                x = r.choice([" ", "\t"]).join(w).title()
            lines.append(x)
        rows.append((i + 1, "\n".join(lines), None, None, 0))
    return [*rows, rows[5], (None, rows[6][1], None, None, None), (50, None, None, None, None), (51, "\n \n", None, None, 3)]


def test_line_removals(spark, no_docs):
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {k: sorted(v) for k, v in brute_removals(spark, rows).items()}
    hashes = {x.h: x.text for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    assert {(x.doc, hashes[x.hash]): x.gone for x in removals(docs).collect()} == want
    assert sum(map(len, want.values())) > 40
    kept = line_dedup(docs)
    assert kept.columns == docs.columns
    expected = Counter()
    for i, t, _, _, n in rows:
        out = want.get((2**63 - 1 if i is None else i, t))
        if out is None:
            expected[i, t, n] += 1
        elif split(cut := "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)):
            expected[i, cut, len(cut)] += 1
    assert Counter((x.doc_id, x.text, x.n_chars) for x in kept.collect()) == expected
    assert line_dedup(no_docs).count() == 0


def changed_lines(seed=10, each=120):
    """(length in words, line, the line with one word or one to three characters changed), edit similarity 0.8 at least."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    out = []
    for n in (8, 12, 20, 40):
        for k in range(each):
            w = [word() for _ in range(n)]
            line = " ".join(w)
            if k % 2:
                w[r.randrange(n)] = word()
            else:
                for _ in range(r.randint(1, 3)):
                    w[r.randrange(n)] += r.choice("0123456789")
            if edit_distance(line, " ".join(w)) <= 0.2 * max(len(line), len(" ".join(w))):
                out.append((n, line, " ".join(w)))
    return out


def test_lines_of_few_changes(spark):
    """All pairs within the radius are found, and nothing that is no copy goes; the share of
    those alike by edits is printed by length, beside lines that differ by stops."""
    found = [(n, x, y) for n, x, y in changed_lines() if x != y]
    r = random.Random(4)
    for n, x, _ in changed_lines(seed=11, each=30):
        w = x.split()
        for k in r.sample(range(n), 3):
            w[k] += r.choice(".,;")
        found.append((-n, x, " ".join(w)))
    docs = spark.createDataFrame([(k + 1, f"{x}\n{y}", None, None, 0) for k, (_, x, y) in enumerate(found)], SCHEMA).repartition(3)
    gone = {x.doc: x.gone for x in removals(docs).collect()}
    assert all(v == [1] for v in gone.values())
    lines = spark.createDataFrame([(f"{k}{s}", t) for k, (_, x, y) in enumerate(found) for s, t in (("x", x), ("y", y))], "k string, line string")
    fps = {x.k: x.fp % 2**64 for x in simhashes(lines, ["k"]).collect()}
    for n in (8, 12, 20, 40, -8, -12, -20, -40):
        ids = [k for k, (m, _, _) in enumerate(found) if m == n]
        print(f"{abs(n)} words, {'any change' if n > 0 else 'stops'}: {len(ids)} lines, found {sum(k + 1 in gone for k in ids) / len(ids):.3f}")
        within = {k for k in ids if (fps[f"{k}x"] ^ fps[f"{k}y"]).bit_count() <= 2}
        assert {k for k in ids if k + 1 in gone} == within
        assert n > 0 or len(within) == len(ids)


def test_very_long_lines(spark):
    """A line of a megabyte and its copy with few words changed; one of other words stays."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    w = [word() for _ in range(150_000)]
    v = [*w[:10], word(), *w[10:]]
    docs = spark.createDataFrame([(1, " ".join(w), None, None, 0), (2, " ".join(v), None, None, 0), (3, " ".join(word() for _ in range(150_000)), None, None, 0)], SCHEMA)
    assert {x.doc: x.gone for x in removals(docs).collect()} == {2: [0]}


def test_edit_similarity_at_every_length(spark):
    """One measure for texts short and long: words taken out, changed and moved, at both sides of 4,096 characters."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(4, 7)))
    rows = []
    for n in (40, 640, 760):
        w = [word() for _ in range(n)]
        changed = [x[:-1] + "z" if k % 3 == 0 else x for k, x in enumerate(w)]
        half = n // 2
        rows += [(" ".join(w), " ".join(v), want) for v, want in (
            (changed[1:], True), ([changed[0], "q", *w[1:]], True), (w[2:-2], True), ([*w[1:half], *changed[half:]], True),
            ([*w[half:], *w[:half]], False), ([*w[half:], "q", *w[:half]], False), ([x[:2] + "zz" + x[4:] for x in w[1:]], False))]
    rows = [(i, x, y, want) for i, (x, y, want) in enumerate(rows)]
    assert {len(x) > 4096 for _, x, _, _ in rows} == {True, False}
    got = {x.i: x.ok for x in spark.createDataFrame(rows, "i long, x string, y string, want boolean").select("i", alike("x", "y", 0.8).alias("ok")).collect()}
    assert got == {i: want for i, _, _, want in rows}
    for i, x, y, want in rows[:7]:
        assert (edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)) == want


def test_op7_and_clashing_columns(spark, tmp_path):
    rows = line_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("__doc", F.lit("a")).withColumn("gone", F.lit("b")).withColumn("hash", F.lit("c")).withColumn("left", F.lit(1))
    kept = line_dedup(docs)
    assert kept.columns == docs.columns
    assert {(x["__doc"], x["gone"], x["hash"], x["left"]) for x in kept.collect()} == {("a", "b", "c", 1)}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_removals(spark, rows)
    expected = Counter((i, sum(bool(words_of_line(x)) for x in (t or "").split("\n")),
                        ",".join(map(str, sorted(want.get((2**63 - 1 if i is None else i, t), ()))))) for i, t, *_ in rows)
    assert Counter((x.doc_id, x.n_lines, x.removed) for x in op7_line_dedup(spark, str(tmp_path)).collect()) == expected


def test_line_dedup_runs_no_python(spark):
    docs = spark.createDataFrame(line_rows(), SCHEMA)
    plan = line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("chunk_chars", [2000, 10**7])
def test_substrings(docs, rows, no_docs, chunk_chars):
    last = 2**63 - 1
    least: dict = {}
    for i, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            least[key] = min(least.get(key, last), last if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        w = split(t)
        gone = {j for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < (last if i is None else i) for j in range(k, k + 13)}
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    assert Counter(map(tuple, substring_dedup(docs, chunk_chars=chunk_chars).collect())) == want
    assert sum(c * k[2] for k, c in want.items()) > 1000
    assert substring_dedup(no_docs).count() == 0
