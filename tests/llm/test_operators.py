"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import json
import os
import time
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same
from quoin.llm import chat, decontaminate, html_crf, jaccard_join, line_dedup, lm, passages, pieces, quality, tokens, topk
from quoin.llm.queries import ORACLES, QUERIES
from quoin.llm.shared import written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, keep string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "x", "y") for i, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


ODD = [(1, "one two three\nfour five"), (1, "one two three\nfour five"), (2, None), (None, "six seven"), (3, ""), (4, "  \n "), (5, "one two three\nother " + "word " * 30_000)]


def test_odd_documents_do_not_fail(spark):
    for texts in (ODD, []):
        d = docs(spark, texts)
        bench = spark.createDataFrame([(1, "two three four five"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
        assert decontaminate.matches(d, bench).count() == (1 if texts else 0)
        assert line_dedup.keep_bitmaps(d).count() == (6 if texts else 0)
        assert line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).columns == d.columns
        assert passages.repeated_passages(d).count() == 0
        assert jaccard_join.similar_pairs(d).count() == 0
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert quality.fit(d, labels).scored(d).filter("_keep").count() == (4 if texts else 0)


def test_jaccard_groups_are_components(spark):
    pairs = spark.createDataFrame([(1, 5), (2, 5), (2, 7), (10, 11), (7, 20), (20, 21)], "doc_id long, other_id long")
    got = {r.doc_id: r.group for r in jaccard_join.groups(pairs).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 7: 1, 20: 1, 21: 1, 10: 10, 11: 10}
    assert jaccard_join.groups(pairs.limit(0)).count() == 0


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6)).round(2)
    v[7] = v[8] = v[9]
    rows = [(i, x.tolist(), "clash") for i, x in enumerate(v)]
    rows += [rows[3], (100, None, ""), (None, [1.0], ""), (101, [], ""), (102, [float("nan"), None, 1.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = {(r.query_id, r["rank"]): (r.item_id, r.score) for r in topk.neighbours(df, k=5, tile_bytes=500, slab_bytes=900).collect()}
    m = {i: x for i, x in enumerate(v)} | {101: np.zeros(6), 102: np.array([0, 0, 1.0, 0, 0, 0])}
    for q, x in m.items():
        best = sorted(((round(float(x @ y), 6) + 0.0, i) for i, y in m.items() if i != q), key=lambda t: (-t[0], t[1]))[:5]
        assert [(got[q, k + 1][1], got[q, k + 1][0]) for k in range(5)] == best
    some = [tuple(r) for r in topk.neighbours(df, k=5, every=50).collect()]
    assert {r[0] for r in some} == {0, 50} and all(got[r[0], r[3]] == (r[1], r[2]) for r in some)
    assert topk.neighbours(df.limit(0)).count() == 0


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [(k, t) for k, t in enumerate(["", " ", "a  b\nc\td ", "the house, of 123 é漢👍Ⅻ", "<s> x", "a" * 300 + "bc" * 90, "abcdefghij" * 30])] + ODD
    for hot in (2, 1_000_000):
        for r in pieces.encode(docs(spark, texts), hot=hot).collect():
            options = [t for i, t in texts if i == r.doc_id]
            assert r.pieces in [None if t is None else library.encode(t) for t in options]
            assert r.exact is (None if r.pieces is None else True)
    back = pieces.decode(pieces.encode(docs(spark, texts))).select("doc_id", "text").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, texts))
    assert pieces.encode(docs(spark, [])).count() == 0


def test_written_tables_leave_no_files_of_shuffles(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getPath() for k in range(found.size()) if "shuffle" in found.apply(k).getPath()}

    before = files()
    assert written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts").count() == 7
    # the count of the rows read has a shuffle of one number for each file
    left = files() - before
    for _ in range(50):  # they go in the background
        if not any(".data" in x and os.path.exists(x) and os.path.getsize(x) > 200 for x in left):
            break
        time.sleep(0.1)
    else:
        raise AssertionError(left)


def test_pieces_read_the_documents_few_times_and_pack_them_well(spark):
    """Long units are no reason to read all documents again; packed codes are short and come back as they were."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = [(k, f"some words of text {k} and {'long' * 30}") for k in range(50)]
    d = docs(spark, texts).mapInArrow(counted, "doc_id long, text string")
    for hot, times in ((1_000_000, 3), (2, 4)):  # for the sum of lengths, the units and the pieces; with holes, for the places of rare units too
        seen.value = 0
        assert pieces.encode(d, hot=hot).count() == 50
        assert seen.value <= times * 50
    counts = np.zeros(30_000)
    counts[[7, 9]] = 5, 8
    codes = pieces.Codes(counts)
    assert codes.of[9] == 1 and codes.of[7] == 2 and (codes.ids[codes.of] == np.arange(30_000)).all()
    some = np.array([1, 0, 127, 128, 16_383, 16_384, 30_000, 2], np.int32)
    data, begin = pieces.Codes.packed(some)
    assert np.diff(begin).tolist() == [1, 1, 1, 2, 2, 3, 3, 1] and len(data) == begin[-1]
    back, ends = pieces.Codes.unpacked(data)
    assert back.tolist() == some.tolist() and ends[begin].tolist() == list(range(9))
    assert [len(x) for x in pieces.Codes.unpacked(data[:0])] == [0, 1]


def test_places_of_names_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(tokens, "hashes", lambda words: np.zeros(len(words), np.uint64))
    names, wanted = (pa.array(x, pa.large_string()) for x in (["a", "b", "c"], ["c", "x", "a", "b", "", "c"]))
    assert pieces.Names(names).places(wanted).tolist() == [2, -1, 0, 1, -1, 2]


def test_viterbi_is_that_of_the_library(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -np.log(k + 1.0) - 0.37 * (k % 7)  # scores without ties
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    words = [(k, t) for k, t in enumerate(["internationalization of the house", "running, jumping", "unbelievable things happen here"])]
    got = {r.doc_id: r.pieces for r in pieces.encode(docs(spark, words), model=str(path)).collect()}
    assert got == {k: library.encode(t) for k, t in words}


def test_chat_layouts(spark):
    rows = [
        {"messages": [{"role": "Human", "content": "a"}, {"role": "bot", "content": "b"}], "extra": 1},
        {"conversations": [{"from": "gpt", "value": "b"}, {"from": None, "value": "c"}]},
        {"instruction": "do", "input": "this", "output": "done", "layout": "clash"},
        {"system": "s", "prompt": "p", "completion": "c"},
        {"dialog": [["x", "y", "z"]]},
        {"question": "q"},
        {"messages": "no list"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(7, None), (8, "no json"), (9, "")], "k int, record string")
    got = {r.k: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical(df).collect()}
    assert got[0] == ("messages", [("user", "a"), ("assistant", "b")])
    assert got[1] == ("conversations", [("assistant", "b"), ("unknown", "c")])
    assert got[2] == ("instruction", [("user", "do\n\nthis"), ("assistant", "done")])
    assert got[3][1] == [("system", "s"), ("user", "p"), ("assistant", "c")]
    assert got[4][1] == [("user", "x"), ("assistant", "y"), ("user", "z")]
    assert all(got[k] == (None, None) for k in range(5, 10))
    odd = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, "b"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    back = {r.conv_id: len(r.turns) for r in chat.canonical(chat.records_of(odd)).collect() if r.turns is not None}
    assert back[1] == 2 and back[None] == 1
    assert chat.records_of(odd.limit(0)).count() == 0


def test_chat_unions_parts_and_clashes(spark):
    parts = [{"type": "text", "text": "see"}, "this", {"type": "image", "url": "u"}]
    rows = [
        {"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "[1]"}], "prompt": "x", "completion": "y"},
        {"question": "q", "answer": "a", "input": "stray"},
        {"prompt": "p", "completion": "c", "response": "r", "meta": {"k": [1, None]}},
        {"messages": [{"role": "user", "content": None}], "prompt": "p", "response": "r"},
        {"messages": [{"role": "user", "content": "x" * 300_000}]},
        {"messages": [{"role": "user", "content": [{"url": "u"}]}, {"role": "user", "content": 5}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(r), "kept", "kept") for k, r in enumerate(rows)], "k int, record string, layout string, turns string")
    out = chat.canonical(df)
    assert out.columns == ["k", "record", "layout", "turns", "_layout", "_turns"]
    got = {r.k: (r._layout, [tuple(t) for t in r._turns]) for r in out.collect()}
    assert all(r.layout == r.turns == "kept" for r in out.collect())
    assert got[0] == ("messages", [("user", "see\nthis"), ("assistant", "[1]")])
    assert got[1] == ("question", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("completion", [("user", "p"), ("assistant", "c")])
    assert got[3] == ("response", [("user", "p"), ("assistant", "r")])
    assert len(got[4][1][0][1]) == 300_000 and got[5][1] == [("user", "5")]
    known = chat.fingerprints()
    texts = ['{"messages":[{"role":"u","content":"a"},{"role":"b","content":"c"}],"system":"s"}', '{"dialog":[["a","b"]]}', '{"output":"o","instruction":"i","input":"x"}']
    shapes = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(chat.shape_of(F.col("t")).alias("s")).collect()]
    assert [known.get(x) for x in shapes] == ["messages", "dialog", "instruction"], shapes


def test_crf_viterbi_and_marginals_by_brute_force():
    rng = np.random.default_rng(1)
    f = html_crf.Field(4)
    f.step = rng.normal(size=(2, 2))
    s = rng.normal(size=(6, 2))
    all_ = {y: sum(s[i, a] for i, a in enumerate(y)) + sum(f.step[a, b] for a, b in zip(y, y[1:])) for y in np.ndindex(*[2] * 6)}
    assert tuple(f.viterbi(s)) == max(all_, key=all_.get)
    z, p, _ = f.marginals(s)
    assert np.isclose(z, np.log(sum(np.exp(list(all_.values())))))
    assert np.isclose(p[2, 1], sum(np.exp(v - z) for y, v in all_.items() if y[2] == 1))


def test_html_held_out_accuracy_and_odd_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    field = html_crf.train(spark.createDataFrame(rows[:120], pages.schema))
    right = total = 0
    for r in rows[120:]:
        blocks = html_crf.blocks_of(r.html)
        y = field.viterbi(field.scores(html_crf.features(blocks)))
        right += sum(int(a) == int(b[3]) for a, b in zip(y, blocks))
        total += len(blocks)
    assert right / total > 0.95
    odd = [None, "", "<p>", "<div><p>a<p>b</div></x>", "<!-- open", "<script>x", "a < b & c &amp; d", "<p>x" * 5000]
    got = html_crf.extract(spark.createDataFrame([(k, h, "t") for k, h in enumerate(odd)], "page_id long, html string, text string"), field).collect()
    assert len(got) == len(odd) and next(r for r in got if r.page_id == 0).text is None


def test_language_model_by_brute_force(spark):
    texts = [(100 + k, " ".join("abcde"[(k + j) % 5] for j in range(40 + k))) for k in range(30)] + ODD
    d = docs(spark, texts)
    model = lm.fit(d, words=6, hidden=4, rounds=1)
    p, cuts, of = model["p"], model["cuts"], model["of"]
    known = {w: i for i, w in enumerate(model["known"].to_pylist())}
    got = {r.doc_id: r for r in lm.scored(d, model).collect() if r.doc_id is not None}
    for i, t in texts[:5]:
        h, prev, total = np.zeros((1, 4), np.float32), len(of), 0.0
        for w in t.split():
            w = known.get(w, len(known))
            h, _ = lm.cell(p, p["emb"][[prev]], h)
            c = np.exp(lm.softmax_log(h @ p["wc"] + p["bc"]))[0, of[w]]
            a, b = cuts[of[w]], cuts[of[w] + 1]
            total += np.log(c * np.exp(lm.softmax_log(h @ p["ww"][a:b].T + p["bw"][a:b]))[0, w - a])
            prev = w
        assert abs(total - got[i].log_likelihood) < 0.02 * abs(total) + 0.01
    assert got[2].n_tokens is None and got[3].n_tokens == 0 and got[3].per_token is None
    assert lm.scored(docs(spark, []), lm.fit(docs(spark, []))).count() == 0


def test_gradients_of_the_language_model():
    p = {k: v.astype(np.float64) for k, v in lm.start(7, 2, 3).items()}
    cuts, of = np.array([0, 3, 7]), np.array([0, 0, 0, 1, 1, 1, 1])
    words = np.array([[1, 4], [5, 2], [0, 6]])

    def loss(steps=None):
        h, prev, total = np.zeros((2, 3)), np.array([7, 7]), 0.0
        for w in words:
            new, memory = lm.cell(p, p["emb"][prev], h)
            if steps is not None:
                steps.append((memory, new, w, prev, np.ones(2, bool)))
            total -= lm.log_probability(p, cuts, of, new, w).sum()
            h, prev = new, w
        return total

    steps, g = [], {k: np.zeros_like(v) for k, v in p.items()}
    loss(steps)
    lm.backward(p, cuts, of, steps, g)
    for k, at in (("wx", (1, 4)), ("wh", (0, 7)), ("wh", (2, 1)), ("emb", (4, 1)), ("wc", (1, 1)), ("ww", (5, 2)), ("b", (2,))):
        p[k][at] += 1e-5
        up = loss()
        p[k][at] -= 2e-5
        down = loss()
        p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4


def test_pipeline_by_brute_force(spark):
    """Near copies, repeated lines and benchmark passages go; the others come out as the library's pieces."""
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5
    base = " ".join(f"word{k}" for k in range(80))
    d = docs(spark, [(1, base), (2, base + " more"), (3, "another text that stays here as it is"), (4, None), (5, "holds w1 w2 w3 w4 w5 w6 w7 w8 w9 of it")])
    assert {r.doc_id for r in cp.dedup_near(spark, d, "").collect()} == {1, 3, 4, 5}
    lines = docs(spark, [(1, "a b\nc d"), (2, "c d\ne f"), (3, "c d")])
    assert {(r.doc_id, r.text) for r in cp.dedup_lines(spark, lines, "").collect()} == {(1, "a b\nc d"), (2, "e f")}
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.clean_documents(d, bench).collect()} == {1, 2, 3, 4}


def test_pipeline_on_odd_documents(spark):
    """Nulls, blank, long and repeated rows and an empty table go through all stages; all but the last keep the columns."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, verdict string"
    clean = "Vaqim lomir tesduk orvane, bilsto remqua ditenfor galumek prostiva."
    rows = [(i, t, "en", None, len(t) if t else None, "kept") for i, t in [*ODD, (7, clean), (7, clean), (8, None)]]
    for some in (rows, []):
        d = spark.createDataFrame(some, schema)
        for name, stage in cp.STAGES:
            columns = d.columns
            d = stage(spark, d, SF)
            if name != cp.STAGES[-1][0]:
                assert d.columns == columns
                d = cp.written(d, "odd")
        got = d.collect()
        assert [r.doc_id for r in got].count(7) == (1 if some else 0)
        assert all(r.exact for r in got if r.pieces is not None)


def test_crf_odd_tables(spark):
    """Equal rows give equal results, ties of Viterbi go to content, an empty table gives no rows and no training."""
    field = html_crf.Field()
    assert field.viterbi(np.zeros((5, 2))).tolist() == [1] * 5
    page = "<html><body><nav>Home About</nav><p>" + "word " * 300_000 + "</p></body></html>"
    df = spark.createDataFrame([(1, page), (1, page), (2, "<p>x</p>")], "page_id long, html string")
    got = html_crf.extract(df, html_crf.train(df)).collect()
    assert len(got) == 3 and len({tuple(r) for r in got}) == 2 and all(r.n_content == r.n_blocks for r in got)
    assert html_crf.extract(df.limit(0), html_crf.train(df.limit(0))).count() == 0


def test_extraction_of_labelled_pages_by_hand(spark):
    """A field trained on marked pages finds the hand-labelled blocks of another page."""
    def page(k, tag):
        body = "".join(f"<p>Sentence number {j} of story {k} tells about the old town and its river.</p>" for j in range(6))
        return f"<html><body><div class='nav'><a href='#'>Home</a> <a href='#'>News</a></div><{tag}>{body}</{tag}><div class='foot'>© {k} Imprint</div></body></html>"

    train = spark.createDataFrame([(k, page(k, "article")) for k in range(30)], "page_id long, html string")
    got = html_crf.extract(spark.createDataFrame([(99, page(99, "section"))], "page_id long, html string"), html_crf.train(train)).first()
    assert got.n_blocks == 8 and got.text == "\n".join(f"Sentence number {j} of story 99 tells about the old town and its river." for j in range(6))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(d, labels.filter("doc_id % 3 <> 0"))
    got = model.scored(d).select("doc_id", "keep").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    bad = [r.keep for r in got if r.toxic == 1]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.3


def test_quality_columns_are_the_ensembles(spark):
    """The compiled column gives what the rules give in numpy; input columns of the results' names stay."""
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null").withColumn("toxicity", F.lit("mine"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.union(labels).union(labels.selectExpr("doc_id", "null", "toxic"))
    model = quality.fit(d, labels)
    stats = quality.statistics(F.col("text"), quality.words_of(F.col("text")), model.abuse)
    rows = model.scored(d).select("toxicity", "_toxicity", "low_quality", "keep", "text", *[F.coalesce(c, F.lit(0.0)).alias("s_" + k) for k, c in stats.items()]).collect()
    x = {k: np.array([r["s_" + k] for r in rows]) for k in stats}
    low, toxic = model.low.probability(x), model.toxic.probability(x)
    for r, a, b in zip(rows, low, toxic):
        assert r.toxicity == "mine"
        if not r.text.strip():
            assert r.low_quality is None and not r.keep
        else:
            assert abs(r.low_quality - a) < 1e-6 and abs(r._toxicity - b) < 1e-6 and r.keep == (round(a, 6) < 0.5 and round(b, 6) < 0.5)


def test_bitmaps_of_many_runs(spark):
    rng = np.random.default_rng(2)
    flags = [[True], [False], [False, True], rng.random(300).tolist() and (rng.random(300) < 0.4).tolist(), [True] * 200 + [False] * 20_000, [k % 2 == 0 for k in range(40_000)]]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(flags)], "k int, f array<boolean>").withColumn("b", line_dedup.bitmap_of(F.col("f")))
    for r in df.withColumn("back", line_dedup.keep_flags(F.col("b"))).collect():
        assert r.back == r.f
        runs = [0] if not r.f[0] else []
        last = None
        for x in r.f:
            if x == last:
                runs[-1] += 1
            else:
                runs.append(1)
            last = x
        want = b""
        for n in runs:
            while n >= 128:
                want, n = want + bytes([n % 128 + 128]), n >> 7
            want += bytes([n])
        assert r.b == want.hex().upper()


def test_decontamination_with_a_very_long_item(spark):
    """Places in a block exceed 32 bits; all planted documents are found."""
    words = [f"w{k}" for k in range(12)]
    d = spark.range(10_000).selectExpr("id as doc_id", f"case when id % 96 = 0 then 'x {' '.join(words)} y' else 'some other text' end as text")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"long{k}" for k in range(300_000)))], "item_id long, text string")
    assert decontaminate.matches(d.coalesce(1), bench).count() == 105


def test_jaccard_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 60))] for _ in range(40)]
    texts = []
    for k in range(160):
        words = list(base[k % 40])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"w{rng.integers(0, 400)}"
        texts.append((k, " ".join(words)))
    sets = {k: set(zip(t.split(), t.split()[1:])) for k, t in texts}
    got = jaccard_join.similar_pairs(docs(spark, texts)).collect()
    linked = {k: {k} for k, _ in texts}
    for r in got:
        if r.jaccard == 1.0 and sets[r.doc_id] == sets[r.other_id]:
            linked[r.doc_id].add(r.other_id)
    pairs = {(min(a, b), max(a, b)) for r in got for a in linked[r.doc_id] for b in linked[r.other_id] if a != b} | {(min(a, b), max(a, b)) for s in linked.values() for a in s for b in s if a < b}
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert pairs == want
    links = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.links(docs(spark, texts)).collect()}
    near = {k: {b for p in want for b in p if k in p and b != k} for k in sets}
    assert {k: n for k, (_, n) in links.items()} == {k: len(x) for k, x in near.items() if x}
    for k, (c, _) in links.items():
        seen, todo = {k}, [k]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert c == min(seen)
    assert jaccard_join.links(docs(spark, [])).count() == 0 and jaccard_join.links(docs(spark, ODD)).count() == 0


def test_lattice_leaves_out_single_ascii(spark):
    vocab = pieces.Vocabulary.load(pieces.MODEL)
    units = spark.createDataFrame([(" zqx\x01é", 1, None), ("q", 1, None)], "unit string, n long, folded array<int>")
    found = pieces.substrings_of(units, vocab, F.length("unit"), True).filter("length(piece) = 1").collect()
    assert sorted((r.unit, r.s, r.piece) for r in found) == [(" zqx\x01é", 0, " "), (" zqx\x01é", 5, "é"), ("q", 0, "q")]
    texts = [(1, "zqx\x01é q \x7f\x00z ~^ jqzé"), (2, "a"), (3, "".join(map(chr, range(128)))), (4, "q\nz\tq  q")]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: list(r.pieces) for r in pieces.encode(docs(spark, texts)).collect()}
    assert got == {i: library.encode(t) for i, t in texts}


def test_jaccard_of_large_groups(spark):
    rng = np.random.default_rng(6)
    texts = []
    # two groups that share half of their words, and a few texts apart
    common = [f"c{x}" for x in range(60)]
    for g in range(2):
        base = common + [f"g{g}w{x}" for x in range(60)]
        for k in range(70):
            words = list(base)
            for x in rng.integers(0, len(words), int(rng.integers(0, 9))):
                words[x] = f"e{rng.integers(0, 10**6)}"
            texts.append((len(texts), " ".join(words)))
    texts += [(len(texts) + k, texts[k][1]) for k in range(10)] + [(500, "some other words"), (501, None), (3, "a text more of an id " + texts[3][1])]
    sets = [(i, frozenset(zip(t.split(), t.split()[1:]))) for i, t in texts if t]
    d = docs(spark, texts)
    few = {(r.doc_id, r.other_id, r.jaccard) for r in jaccard_join.similar_pairs(d, heavy=10**9).collect()}
    assert {(r.doc_id, r.other_id, r.jaccard) for r in jaccard_join.similar_pairs(d, heavy=3).collect()} == few
    want = {(min(i, j), max(i, j)) for (i, a), (j, b) in combinations(sets, 2) if i != j and a != b and len(a & b) / len(a | b) >= 0.8}
    least = {s: min(i for i, x in sets if x == s) for _, s in sets}
    assert {(a, b) for a, b, _ in few} >= {p for p in want if all(any(least[s] == i for j, s in sets if i == j) for i in p)}
    links = [sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.links(d, heavy=h).collect()) for h in (3, 10**9)]
    assert links[0] == links[1]
    assert {i for i, _, _ in links[0]} == {x for (i, a), (j, b) in combinations(sets, 2) if i != j and len(a & b) / len(a | b) >= 0.8 for x in (i, j)}


def test_jaccard_rows_of_a_key_grow_with_its_sets():
    n = 2000
    keys, who = np.full(n, 7, np.uint64), np.arange(n)
    batch = jaccard_join.pack_keys(np.zeros(n, np.int32), keys, who, np.full(n, 3), np.arange(1, n + 1), np.full(n, 100))
    found = jaccard_join.matcher(0.8, 8, 64)(pa.Table.from_batches([batch]))
    assert found.num_rows == n and set(found["kind"].to_pylist()) == {2} and sorted(found["b"].to_pylist()) == list(range(1, n + 1))
    rng = np.random.default_rng(7)
    a, b = ([np.unique(rng.integers(0, 400, 60)).astype(np.uint64) for _ in range(m)] + [np.array([9], np.uint64)] for m in (30, 40))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard_join.intersections(a, b, 16, 100).tolist() == want
    # rare elements alone
    assert jaccard_join.intersections([x + np.uint64(1000 * k) for k, x in enumerate(a)], [x + np.uint64(1000 * k) for k, x in enumerate(a)], 16, 100).sum() > 0


def filler(rng, n):
    return [f"f{x}" for x in rng.integers(0, 10**9, n)]


def test_passages_of_many_documents_give_all_their_pairs(spark):
    rng = np.random.default_rng(7)
    texts, want, at = [], set(), 0
    for holders in (10, 40):  # the latter is more than passages.HOT
        passage = filler(rng, 67)
        ids = range(at, at + holders)
        at += holders
        texts += [(i, " ".join(filler(rng, 30 + i) + passage + filler(rng, 20))) for i in ids]
        # more holders than passages.HOT are a class, each linked with the first
        want |= {(b, a) for a, b in combinations(ids, 2) if holders <= passages.HOT or a == ids[0]}
    # fragments in the documents between and before hide the passage of C and D
    passage = filler(rng, 67)
    a, b, c, e, f, d = range(at, at + 6)
    part = {a: passage[:45], b: passage[22:], c: passage, e: passage[:45], f: passage[22:], d: passage}
    texts += [(i, " ".join(filler(rng, 25) + p + filler(rng, 25))) for i, p in part.items()]
    want |= {(d, c)}
    got = passages.repeated_passages(docs(spark, texts)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == want
    assert all(r.identity == 1 and r.matched >= 67 for r in got)


def test_passages_of_copies_and_long_ends(spark):
    rng = np.random.default_rng(9)
    passage, tail = filler(rng, 60), filler(rng, 2000)
    first = " ".join(filler(rng, 20) + passage + filler(rng, 20))
    # more than passages.HOT documents hold the tail in pieces, so that only its start has common seeds of few documents
    texts = [(1, first), (2, first.upper() + " ."), (2, first.upper() + " ."), (3, " ".join(filler(rng, 9) + passage)), (4, None), (None, first), (5, ""), (6, "a b"), (7, "a b")]
    texts += [(100 + k, " ".join(filler(rng, 5) + tail[:n] + filler(rng, 5))) for k, n in enumerate([700, 700, 2000])]
    got = {(r.doc_id, r.other_id): r for r in passages.repeated_passages(docs(spark, texts)).collect()}
    assert set(got) == {(2, 1), (3, 1), (101, 100), (102, 100), (102, 101)}
    assert (got[2, 1].start, got[2, 1].end, got[2, 1].matched, got[2, 1].identity) == (0, 100, 100, 1.0)
    assert (got[3, 1].start, got[3, 1].other_start, got[3, 1].matched) == (9, 20, 60)
    assert all(got[p].matched == 700 for p in ((101, 100), (102, 100), (102, 101)))


def test_ends_of_passages_are_followed_to_where_they_differ():
    """A copy goes on 500 tokens past the last seed; the aligner asks for more tokens until it has seen its end."""
    rng = np.random.default_rng(10)
    a = rng.integers(0, 10**9, 900)
    b = np.concatenate((rng.integers(0, 10**9, 30), a[:600], rng.integers(0, 10**9, 300)))
    chain, reach = np.array([[50, 100, 80]]), passages.REACH
    while True:
        sides = [[x[p:q].tolist() for p, q in passages.ranges_of(chain, k, reach)] for k, x in ((0, a), (1, b))]
        found = list(passages.aligned(chain, *sides, 50, 0.75, passages.DROP, reach))
        if None not in found:
            break
        reach *= 8
    assert reach > 500 and found == [(0, 600, 30, 630, 600)]


def test_periodic_passages_keep_their_length(spark):
    rng = np.random.default_rng(8)
    for period in (1, 15):
        word = filler(rng, period)
        texts = [(i, " ".join(filler(rng, 30) + (word * 300)[:n] + filler(rng, 30))) for i, n in ((1, 120), (2, 250))]
        row = max(passages.repeated_passages(docs(spark, texts)).collect(), key=lambda r: r.matched)
        assert (row.doc_id, row.other_id) == (2, 1) and row.matched >= 120


def test_recall_of_edited_passages(spark):
    """Passages of 50 to 80 tokens with up to a quarter of the tokens replaced, the first and last kept: all meet the definition."""
    rng = np.random.default_rng(11)
    texts, kinds = [], {}
    for size in (50, 60, 80):
        for changed in (0.1, 0.15, 0.2, 0.24):
            for _ in range(60):
                passage = filler(rng, size)
                other = list(passage)
                for x in rng.choice(np.arange(1, size - 1), int(changed * size), False):
                    other[x] = filler(rng, 1)[0]
                k = len(texts)
                kinds[k + 1, k] = size, changed
                texts += [(k + n, " ".join(filler(rng, 40) + p + filler(rng, 40))) for n, p in enumerate((passage, other))]
    # a change at every sixth token
    passage = filler(rng, 60)
    kinds[len(texts) + 1, len(texts)] = 60, "regular"
    texts += [(len(texts) + n, " ".join(filler(rng, 40) + p + filler(rng, 40))) for n, p in enumerate((passage, [x if i % 6 != 5 else "changed" for i, x in enumerate(passage)]))]
    got = {(r.doc_id, r.other_id) for r in passages.repeated_passages(docs(spark, texts)).collect()}
    assert got <= set(kinds)
    recall = {kind: np.mean([p in got for p, x in kinds.items() if x == kind]) for kind in set(kinds.values())}
    print(recall)
    assert min(recall.values()) >= 0.9, recall


def test_passages_of_one_seed_and_of_two_hot_ones(spark):
    rng = np.random.default_rng(12)

    def edited(long):
        """Two passages of runs of 3 equal tokens, but for the runs numbered ``long``, with a change between."""
        a, b, runs = [], [], []
        for k in range(13):
            run = filler(rng, 4 if k in long else 3)
            runs.append(run)
            a += run + filler(rng, 1)
            b += run + filler(rng, 1)
        return a[:-1], b[:-1], [runs[k] for k in long]

    (a, b, _), (c, d, hot) = edited([6]), edited([4, 9])  # the latter two 21 tokens apart
    texts = [(k, " ".join(filler(rng, 30) + x + filler(rng, 30))) for k, x in enumerate((a, b, c, d))]
    texts += [(10 + k, " ".join(filler(rng, 9) + x + filler(rng, 9))) for k, x in enumerate(hot * (passages.HOT + 5))]
    got = {(r.doc_id, r.other_id): r.matched for r in passages.repeated_passages(docs(spark, texts)).collect()}
    assert got == {(1, 0): 40, (3, 2): 41}


def test_outputs_of_many_states_take_little_memory_and_are_right():
    rng = np.random.default_rng(3)
    cuts = np.arange(0, 1601, 8)
    of = np.repeat(np.arange(200), 8)
    p = lm.start(1600, 200, 4) | {"wc": rng.normal(0, 1, (4, 200)).astype(np.float32), "ww": rng.normal(0, 1, (1600, 4)).astype(np.float32)}
    h, word = rng.normal(0, 1, (20_000, 4)).astype(np.float32), rng.integers(0, 1600, 20_000)
    tracemalloc.start()
    got = lm.log_probability(p, cuts, of, h, word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # a row of 200 classes for each state alone has 16 MB
    for i in (0, 1023, 1024, 12_345, 19_999):
        c = of[word[i]]
        inside = lm.softmax_log(h[i] @ p["ww"][cuts[c] : cuts[c + 1]].T)[word[i] - cuts[c]]
        assert abs(got[i] - lm.softmax_log(h[i] @ p["wc"])[c] - inside) < 1e-4


def test_vocabulary_grows_and_unknown_words_are_spelt(spark):
    texts = [(k, " ".join(["alpha", "beta", "gamma", "delta"] * 5 + [f"ra{'re' * (k % 7)}th{'an' * (k % 5)}"])) for k in range(20)]
    d = docs(spark, texts)
    model = lm.fit(d, words=2, hidden=4, rounds=1)
    assert set(model["known"].to_pylist()) == {"alpha", "beta", "gamma", "delta"}  # 100 times each
    new = docs(spark, [(1, "alpha rarethan"), (2, "alpha qzxjkvwp"), (3, "alpha")])
    got = {r.doc_id: r.log_likelihood for r in lm.scored(new, model).collect()}
    log = model["spelling"].log
    assert got[1] > got[2] + 5 and abs(got[1] - got[2] - log("rarethan") + log("qzxjkvwp")) < 0.01
    # after a letter, the probabilities of all that may follow are 1
    pair = lambda a, b: (a + 1) << 32 | b + 1
    follow = lm.Spelling({pair(-1, 97): 3, pair(97, 98): 2, pair(98, -1): 2, pair(97, -1): 1})
    single = {97: 3, 98: 2, -1: 3}
    seen = [(n + (single[b] + 1 / 0x110001) / 9) / 4 for b, n in ((97, 0), (98, 2), (-1, 1))]
    rest = (0x110001 - 3) * (1 / 0x110001) / 9 / 4
    assert abs(sum(seen) + rest - 1) < 1e-9
    assert abs(follow.log("a") - np.log((3 + (3 + 1 / 0x110001) / 9) / 4) - np.log(seen[2])) < 1e-9
    both = follow.logs(lm.pa.array(["a", "ab\U0001f44d", ""], lm.pa.large_string()))
    assert abs(both[0] - follow.log("a")) < 1e-12 and abs(both[1] - follow.log("ab\U0001f44d")) < 1e-12


def test_language_model_learns_from_every_document(spark):
    d = docs(spark, [(k, " ".join("abcdefgh"[(k + j) % 8] for j in range(200 + k))) for k in range(40)])
    d = d.filter(F.pmod(F.xxhash64("text"), F.lit(16)) != 0)  # none of them is in a sixteenth by the hash
    model = lm.fit(d, rounds=1)
    begun = lm.start(len(model["of"]), len(model["cuts"]) - 1, lm.HIDDEN)
    assert np.abs(model["p"]["wx"] - begun["wx"]).max() > 0.01
    per = [r.per_token for r in lm.scored(d, model).collect()]
    assert np.mean(per) > -1.5  # ln(1/8) = -2.08 by frequencies alone


def test_html_digits_of_the_whole_block():
    lead = "word " * 500
    plain, log = (html_crf.features([(x, ("div",), 0.0, False)]) for x in (lead + "word " * 2000, lead + "12345 " * 2000))
    digits = {html_crf.zlib.crc32(f"digits{k}".encode()) & ((1 << html_crf.HASH_BITS) - 1): k for k in range(11)}
    assert [digits[x] for x in plain[0].tolist() if x in digits] == [0]
    assert [digits[x] for x in log[0].tolist() if x in digits] == [6]


def test_edited_copies_of_items_with_absent_words_go(spark):
    words = [f"w{k}" for k in range(24)]
    edited = [w if k % 6 != 5 else "changed" for k, w in enumerate(words)]
    d = docs(spark, [(1, " ".join(["lead"] * 9 + edited)), (2, "another text"), (3, "w0 w1 w2")])
    bench = spark.createDataFrame([(1, " ".join(words[:23] + ["nowhere"]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.clean_documents(d, bench).collect()} == {2, 3}


def test_outputs_of_large_vocabularies_are_few_and_right():
    n = np.append((1e7 / np.arange(1, 100_001)).astype(int), 1e6)
    cuts = lm.classes_of(n)
    mass = np.add.reduceat(n, cuts[:-1])
    groups = lm.groups_of(mass)
    # outputs of a word: the groups, the classes of its group, the words of its class
    per = len(groups) - 1 + np.repeat(np.diff(groups), np.add.reduceat(np.diff(cuts), groups[:-1])) + np.repeat(np.diff(cuts), np.diff(cuts))
    assert (per * n).sum() / n.sum() < 160  # two levels took more than 300
    # probabilities over all words are 1, and gradients those by differences
    rng = np.random.default_rng(5)
    cuts = lm.classes_of(n[:1200])
    groups = lm.groups_of(np.add.reduceat(n[:1200], cuts[:-1]))
    of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    p = {k: rng.normal(0, 1, v.shape) for k, v in lm.start(1200, len(cuts) - 1, 3, groups=len(groups) - 1).items()}
    log = lambda h, w: lm.log_probability(p, cuts, of, h, w, groups)
    h = rng.normal(0, 1, (1, 3))
    assert abs(np.exp(log(np.repeat(h, 1200, 0), np.arange(1200))).sum() - 1) < 1e-9
    words = np.concatenate((rng.integers(0, 1200, 100), np.full(60, 40), [1199]))
    memory, new = lm.cell(p, p["emb"][words], np.zeros((161, 3)))[::-1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    lm.backward(p, cuts, of, [(memory, new, words, words, np.ones(161, bool))], g, groups)
    for k, at in (("wg", (1, 2)), ("bg", (0,)), ("wc", (1, of[40])), ("bc", (of[words[0]],)), ("ww", (40, 1)), ("ww", (words[3], 0)), ("bw", (words[5],)), ("wx", (1, 4))):
        ends = []
        for d in (1e-5, -1e-5):
            p[k][at] += d
            ends.append(-log(lm.cell(p, p["emb"][words], np.zeros((161, 3)))[0], words).sum())
            p[k][at] -= d
        assert abs((ends[0] - ends[1]) / 2e-5 - g[k][at]) < 1e-4
    # outputs beyond what exponentials hold
    p["bw"] += 1000.0
    p["bg"][0] -= 500.0
    assert np.isfinite(log(np.repeat(h, 1200, 0), np.arange(1200))).all()


def test_passages_in_slices_are_the_same_and_leave_no_links(spark):
    rng = np.random.default_rng(7)
    shared, few = [filler(rng, 60) for _ in range(6)], filler(rng, 5)  # the latter is looked at in short and gives no passage
    texts = [(k, " ".join(filler(rng, 30) + shared[k % 6] + filler(rng, 30) + few + filler(rng, 30))) for k in range(24)]
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = [sorted(map(tuple, passages.repeated_passages(docs(spark, texts), slices=n).collect())) for n in (1, 3)]
    assert rows[0] == rows[1] and len({r[:2] for r in rows[0]}) == 36
    # what later tables were made from doesn't stay on disk
    assert {name.split("-")[0] for name in set(os.listdir(folder)) - before}.isdisjoint({"links", "chains", "windows"})
