import random
from collections import Counter

import numpy as np
import pytest

from bagworks.llm.cells import cells_of, windows, words
from bagworks.llm.mixing import mix_sources, plan_mixture, shares_report
from bagworks.llm.packing import Capacity, best_fit, pack_documents
from bagworks.llm.subjects import Chain, assign_subjects, copied_windows, digest
from bagworks.llm.tokens import VOCABULARY, count_tokens, encoding

CELLS = "array<struct<cell_type string, exec_count int, char_start int, char_len int>>"
DOCS = f"doc_id bigint, text string, source string, fmt string, cells {CELLS}, words string, h bigint"


def test_tokens(spark):
    enc = encoding(VOCABULARY)
    texts = ["", None, "hello world", "Straße <|endoftext|> 𝒳 \n\n  x", "a" * 20_000, " ".join(map(str, range(5000)))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("cost", [None, 300_000.0])
def test_best_fit_keeps_every_constraint(rule, cost):
    rng = np.random.default_rng(3)
    sizes = np.minimum(1000, (rng.pareto(1.2, 3000) * 40).astype(int))
    cap = Capacity(tokens=1000, items=30, cost=cost, rule=rule)
    bins = best_fit(sizes, cap)
    for b in range(bins.max() + 1):
        own = sizes[bins == b]
        assert 0 < len(own) <= 30 and own.sum() <= 1000
        assert len(own) == 1 or (own.astype(float) ** 2).sum() <= cap.most_cost
    if cost is None:
        assert bins.max() + 1 <= max(-(-sizes.sum() // 1000), -(-len(sizes) // 30)) * 1.03 + 1


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, rng.randint(1, 900), rng.randint(900, 5000)])) for i in range(3000)] + [(5000, None), (None, 7), (5001, 1000), (5002, 2000)]
    cap = Capacity(tokens=1000, items=40)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, n_tokens bigint, bin string, shard int")
    got = pack_documents(df, cap, shard_items=300).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pack_documents(df, cap, shard_items=300).collect()))
    sizes, bins = {i: n or 0 for i, n in rows if i is not None}, {}
    for i, n in sizes.items():
        own = sorted((r.piece, r.n_tokens) for r in got if r.doc_id == i)
        assert [p for p, _ in own] == list(range(max(1, -(-n // 1000)))) and sum(t for _, t in own) == n
        assert all(t == 1000 for _, t in own[:-1])
    for r in got:
        bins.setdefault(r.container_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and len(own) <= 40 and sum(r.n_tokens for r in own) <= 1000
        assert [r.start for r in own] == [sum(q.n_tokens for q in own[:k]) for k in range(len(own))]
    assert sum(sizes.values()) / (len(bins) * 1000) > 0.97


def test_packing_nothing_and_bad(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
    assert pack_documents(spark.createDataFrame([(1, 0)], "doc_id bigint, n_tokens bigint")).count() == 1
    with pytest.raises(ValueError):
        Capacity(tokens=0)


def test_plan_gives_what_sources_lack_to_the_others():
    totals = {"a": 1000, "b": 1000, "c": 10}
    budget, v, given = plan_mixture(totals, {"a": (0.5, 1), "b": (0.3, 1), "c": (0.2, 2), "none": (0.1, 3)}, 1000)
    assert budget == 1000 and given["c"] == 20 and given["none"] == 0
    assert abs(given["a"] / given["b"] - 5 / 3) < 0.01 and abs(sum(given.values()) - 1000) <= 2
    assert plan_mixture({}, {"a": (1.0, 1)})[0] == 0


def test_mixture(spark):
    rng = random.Random(2)
    spell = {"big": ["big", "BIG", " big "], "small-one": ["small-one", "small_one", "Small One"], "tiny": ["tiny"], "other": ["other", None]}
    rows, i = [], 0
    for s, n in (("big", 3000), ("small-one", 300), ("tiny", 20), ("other", 200)):
        for _ in range(n):
            rows.append((i, rng.choice(spell[s]), rng.choice([0, None, rng.randint(1, 200)]), "clash"))
            i += 1
    docs = spark.createDataFrame(rows + [(None, "big", 5, "x")], "doc_id bigint, source string, n_tokens bigint, before string")
    targets = spark.createDataFrame([("Big", 0.5, 1), ("small one", 0.4, 2), ("tiny", 0.1, 3), ("nowhere", 0.2, 4)], "source string, target_share double, max_repeats int")
    budget = 60_000
    got = mix_sources(docs, targets, budget=budget).orderBy("seq").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(docs, targets, budget=budget).collect()))
    uses = Counter((r.doc_id, r.source) for r in got)
    most = {"big": 1, "small-one": 2, "tiny": 3}
    assert all(k <= most[s] for (_, s), k in uses.items())
    total = sum(r.n_tokens for r in got)
    assert budget - 400 <= total <= budget
    assert [r.vft for r in got] == sorted(r.vft for r in got)
    at = 0
    for r in sorted(got, key=lambda r: (r.seq, r.seq + r.n_tokens)):
        assert r.seq == at
        at += r.n_tokens
    # the order within a repeat is the same in each, every document once before any twice
    _, _, plan = plan_mixture({s: sum(n or 0 for _, x, n, _ in rows if x and "-".join(x.lower().replace("_", " ").replace("-", " ").split()) == s) for s in most}, {"big": (0.5, 1), "small-one": (0.4, 2), "tiny": (0.1, 3)}, budget)
    own = Counter()
    for r in got:
        own[r.source] += r.n_tokens
    assert all(abs(own[s] - plan[s]) <= 400 for s in most)
    report = {r.source: r for r in shares_report(mix_sources(docs, targets, budget=budget), docs, targets).collect()}
    assert report["nowhere"].used_tokens == 0 and report["tiny"].top_repeat == 3 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-4


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", None, 1), ("c", -1.0, 2)], "source string, target_share double, max_repeats int")
    assert mix_sources(docs, targets).count() == 0
    assert mix_sources(spark.createDataFrame([(1, "a", 3)], docs.schema), targets.where("source = 'q'")).count() == 0


def test_cells_read_alike_in_every_form():
    forms = {
        "export": ("In [12]:\nx = load_rates(1)\nprint(x)", "code"),
        "percent": ("# %%\nx = load_rates(1)\nprint(x)", "code"),
        "json": ('{"cell_type": "code", "execution_count": 3, "source": "x = load_rates(1)\\nprint(x)"}', "code"),
    }
    read = [next(cells_of(t, [(k, 0, len(t))], f)) for f, (t, k) in forms.items()]
    assert len({(r, s.strip()) for r, s in read}) == 1
    assert words(read[0][1]) >= {"load_rates", "load", "rates", "print"}
    assert list(cells_of(None, [], "json")) == [] and list(cells_of("only text", [], None)) == [("m", "only text")]
    assert words("x " + "A1b2" * 40) == set()
    assert len(windows(["a", "b"])) == 0 and len(windows(["a", "b", "c", "d"])) == 2


SUBJECTS = {"law": [f"statute{c}" for c in "abcdefghij"], "food": [f"recipe{c}" for c in "abcdefghij"], "sky": [f"comet{c}" for c in "abcdefghij"]}
#: One block, pasted into many notebooks.
BLOCK = ["Tutorial one", "Table of recipea and recipeb", "recipec reciped recipee", "and so on"]


def notebook(rng, about, block):
    cells = [f"Intro {rng.random()}"]
    for s in about:
        cells += [f"We look at {' and '.join(rng.sample(SUBJECTS[s], 3))} in part {rng.random()}" for _ in range(4)]
    if block:
        cells += BLOCK
    if rng.random() < 0.4:
        cells.append(f"(see {rng.choice(SUBJECTS['sky'])} elsewhere) {rng.random()}")
    text, spans = "", []
    for c in cells:
        spans.append(("markdown", None, len(text), len(c)))
        text += c + "\n\n"
    return text, spans


def corpus(n=400):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(n):
        truth[i] = sorted(rng.choice([["law"], ["food"], ["sky"], ["law", "sky"], []]))
        text, spans = notebook(rng, truth[i], rng.random() < 0.3)
        rows.append((i, text, rng.choice(["Src A", "src_a", "b", None]), "export", spans, "clash", 1))
    rows += [(n, "", "b", "json", [], "", 0), (n + 1, None, None, None, None, None, None), (n + 2, "no cells here", "b", None, None, "", 0)]
    return rows, truth


@pytest.mark.parametrize("copied_rows", [500_000, 0])
def test_subjects_on_held_out_documents(spark, copied_rows):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, s) for i in range(0, 400, 2) for s in (truth[i] or [None])] + [(0, truth[0][0] if truth[0] else None), (None, "law")]
    got: dict = {}
    for r in assign_subjects(docs, spark.createDataFrame(labels, "doc_id bigint, subject string"), list(SUBJECTS), copied_rows=copied_rows).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    held = [i for i in range(1, 400, 2)]
    right = sum(sorted(got.get(i, [])) == truth[i] for i in held)
    assert right / len(held) > 0.95
    assert not {400, 401, 402} & got.keys()


def test_subjects_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    assert assign_subjects(docs, labels, ["a"]).count() == 0
    rows, _ = corpus(12)
    assert assign_subjects(spark.createDataFrame(rows, DOCS), labels, ["a", "b"]).count() == 0


def test_beam_finds_the_most_probable_combination():
    rng = np.random.default_rng(5)
    k, n = 4, 60
    counts = rng.integers(0, 5, (n, k, 5))
    y = (counts[:, :, 0] >= 3).astype(float)
    m = Chain([f"s{i}" for i in range(k)], sources=["a"])
    source, shape = rng.integers(0, 2, n), rng.integers(0, 9, (n, 4)).astype(float)
    m.fit(counts, source, shape, y)
    labels, score = m.decode(counts, source, shape, beam=2**k)
    few, low = m.decode(counts, source, shape, beam=4)
    assert (low <= score + 1e-9).all() and (few == labels).mean() > 0.95
    shared = m.shared(counts, source, shape)
    for combo in np.ndindex(*[2] * k):
        c = np.tile(np.array(combo, float), (n, 1))
        total = np.zeros(n)
        for place, s in enumerate(m.order):
            before = np.zeros_like(c)
            before[:, m.order[:place]] = c[:, m.order[:place]]
            z = m.logits(m.features(counts, shared, s, before), place)
            total += -np.logaddexp(0, np.where(c[:, s] == 1, -z, z))
        assert (total <= score + 1e-9).all()


def changed_copies(n, first):
    """One notebook about law n times: run again, in two forms, and with one cell edited."""
    rng = random.Random(6)
    cells = [("markdown", "Intro"), *[("code" if j % 2 else "markdown", f"We look at {' and '.join(rng.sample(SUBJECTS['law'], 3))} in part {j}") for j in range(8)], ("markdown", "The end")]
    rows = []
    for i in range(n):
        text, spans, edited, form = "", [], rng.randrange(1, 9), ("export", "percent")[i % 2]
        for j, (kind, c) in enumerate(cells):
            mark = {"export": f"In [{rng.randrange(99)}]:\n" if kind == "code" else "", "percent": "# %%\n" if kind == "code" else "# %% [markdown]\n# "}[form]
            c = mark + (f"edited {rng.random()}" if j == edited else c)
            spans.append((kind, None, len(text), len(c)))
            text += c + "\n"
            if kind == "code":
                out = f"took {rng.random()} s"
                if rng.random() < 0.3:
                    spans.append(("output", None, len(text), len(out)))
                    text += out + "\n"
        rows.append((first + i, text, "b", form, spans, "clash", 1))
    return rows


@pytest.mark.parametrize("copied_rows", [500_000, 0])
def test_changed_copies_of_a_notebook_keep_their_subject(spark, copied_rows):
    rows, truth = corpus()
    copies = changed_copies(120, 1000)
    labels = spark.createDataFrame([(i, s) for i in range(0, 400, 2) for s in (truth[i] or [None])], "doc_id bigint, subject string")
    got: dict = {}
    for r in assign_subjects(spark.createDataFrame(rows + copies, DOCS), labels, list(SUBJECTS), copied_rows=copied_rows).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert sum(got.get(r[0]) == ["law"] for r in copies) >= 0.95 * len(copies)
    held = list(range(1, 400, 2))
    assert sum(sorted(got.get(i, [])) == truth[i] for i in held) / len(held) > 0.95


def test_windows_are_counted_by_notebook(spark):
    rows, _ = corpus()
    plain = {r.h for r in copied_windows(digest(spark.createDataFrame(rows, DOCS))).collect()}
    assert plain >= set(windows(BLOCK).tolist())
    more = {r.h for r in copied_windows(digest(spark.createDataFrame(rows + changed_copies(120, 1000), DOCS))).collect()}
    assert more == plain


def test_items_that_fill_nothing_well_stay_in_shards_of_their_size(spark, monkeypatch):
    """Items of more than half a container can't share one: no level puts more of them in a task than the shard's size says."""
    import bagworks.llm.packing as p

    seen, pack = [], p._pack

    def spy(df, level, cap):
        seen.append((level, df.groupBy("shard").count().agg({"count": "max"}).first()[0]))
        return pack(df, level, cap)

    monkeypatch.setattr(p, "_pack", spy)
    df = spark.range(3000).selectExpr("id as doc_id", "5000 + id % 97 as n_tokens")
    got = pack_documents(df, Capacity(8192, 64), shard_items=300).collect()
    assert len(got) == len({r.doc_id for r in got}) == len({r.container_id for r in got}) == 3000
    assert len(seen) == 2 and max(n for _, n in seen) < 400


def test_places_and_cost_bind(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "(id * 37) % 900 as n_tokens")
    cap = Capacity(8192, 12, cost=2_000_000.0)
    by = {}
    for r in pack_documents(df, cap, shard_items=500).collect():
        by.setdefault(r.container_id, []).append(r.n_tokens)
    assert sum(map(len, by.values())) == 2000 and all(len(v) <= 12 and sum(x * x for x in v) <= cap.cost for v in by.values())
    fewest = max(2000 / 12, sum(x * x for v in by.values() for x in v) / cap.cost)
    assert len(by) < 1.15 * fewest
