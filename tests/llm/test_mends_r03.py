"""Cases of the round 2 review: rare languages, ids on two texts, lost conversations and page texts, null distances."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlens.llm import bpe, chat, html_text, langid, minhash, quality_model, quality_rules, repeats
from churnlens.session import ship_package
from test_words_ops import brute_near

SF, SF_LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"

ITALIAN = [
    "Era una mattina di primavera e la piazza del mercato si riempiva di gente che comprava il pane e le verdure.",
    "Il ragazzo scriveva lettere lunghe alla sorella, che viveva in una citt\u00e0 lontana vicino al mare.",
    "Nessuno ricordava quando fosse stata costruita la vecchia torre sopra la collina degli ulivi.",
    "La nonna preparava ogni domenica la pasta fresca per tutta la famiglia e per gli amici dei nipoti.",
    "Gli studenti aspettavano il treno della sera parlando di calcio, di musica e degli esami di giugno.",
]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def test_rare_languages_are_kept_and_no_declared_document_is_rejected(spark):
    docs = spark.read.parquet(f"{SF_LARGE}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(-1 - k, t, "it", "src0") for k, t in enumerate(ITALIAN)], docs.schema)
    noise = spark.createDataFrame([(-100, "qwrtz pklmn xvbdf ghjkl zrtpq wkjhg nbvcx " * 4, None, "src0")], docs.schema)
    got = langid.identify(langid.document_evidence(docs.unionByName(more).unionByName(noise))).collect()
    assert {r.language for r in got if -6 < r.id < 0} == {"it"}
    assert [r for r in got if r.id > -6 and r.trigrams and not r.kept] == []
    assert all(r.kept for r in got if r.id > -6 and r.trigrams)
    assert [r.kept for r in got if r.id == -100] == [False]


def test_near_duplicates_recall_on_a_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num in (80, 85):
        got = minhash.near_duplicate_classes(docs, num=num).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute_near(rows, num)


def test_one_id_on_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, a.upper()), (3, b + " tail"), (9, c), (9, c), (9, a + " more"), (20, c + " x"), (None, a)]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, words string")
    got = minhash.near_duplicate_classes(docs, num=80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_near(rows, 80)
    kept = minhash.drop_near_duplicates(docs, num=80)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(3, b + " tail"), (None, a)]))
    alone = spark.createDataFrame([(1, a), (1, b), (1, a + " "), (2, c)], "doc_id long, text string")
    left = [(r.doc_id, r.text.strip()) for r in minhash.drop_near_duplicates(alone).collect()]
    assert sorted(left) == [(1, a), (1, b), (2, c)]


def test_conversations_without_known_records_stay(spark):
    records = [
        (1, {"instruction": "i", "input": "n", "output": "o", "system": "s"}),
        (2, {"prompt": "p", "completion": "c", "system": "s"}),
        (3, {"messages": []}),
        (4, {"what": "is this"}),
        (5, {"messages": [{"role": "user", "content": "a"}], "system": "s"}),
        (None, {"prompt": "p", "completion": "c"}),
        (None, {"prompt": "q", "completion": "c"}),
    ]
    rows = [(k, 0, json.dumps(r)) for k, r in records] + [(6, 0, None), (7, 0, "{broken")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = chat.format_conversations(frame).collect()
    turns = {r.conv_id: chat.read_turns(r.formatted) for r in got if r.conv_id is not None}
    assert turns[1] == [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]
    assert turns[2] == [("system", "s"), ("user", "p"), ("assistant", "c")]
    assert turns[5] == [("system", "s"), ("user", "a")] and turns[3] == turns[4] == turns[6] == turns[7] == []
    assert sorted(chat.read_turns(r.formatted)[0][1] for r in got if r.conv_id is None) == ["p", "q"]
    assert sorted(r.conv_id for r in chat.unmapped_records(frame).collect()) == [4, 6, 7]


@pytest.mark.parametrize("text", ["\\### A: </turn> ok", "#######", "##</turn></turn>", "a\\", "</turn", "### #### ##### </turn>\n"])
def test_no_control_string_inside_texts(text):
    done = chat.escape(text)
    assert "###" not in done and "</turn>" not in done and chat.unescape(done) == text
    whole, spans = chat.write_turns([{"role": "user", "text": text}, {"role": "assistant", "text": text}])
    assert chat.read_turns(whole) == [("user", text), ("assistant", text)]
    assert whole.count("###") == whole.count("</turn>") == 2
    assert chat.unescape(whole[spans[0]["start"] : spans[0]["end"]]) == text


def test_form_and_drawing_texts_are_visible():
    page = (
        "<p>Pick <select><option>red<option selected>blue</select> or <textarea>typed text</textarea> and"
        "<math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><title>no</title><text>label</text></svg> <button>Go</button>"
        "<input type=hidden value=h> <input value='a value'> <select multiple><option>one<option>two</select></p>"
    )
    text = html_text.visible_text(page)
    for shown in ("blue", "typed text", "x=2", "label", "Go", "a value", "one", "two"):
        assert shown in text
    for hidden in ("red", "no", "hidden"):
        assert hidden not in text.split()
    assert html_text.visible_text("<select><option disabled>none<option>first<option>last</select>") == "first"


def test_languages_without_word_list_have_no_word_distance(spark):
    text = "Nessuno ricordava quando fosse stata costruita la vecchia torre sopra la collina degli ulivi del paese"
    docs = spark.createDataFrame([(k, text + f" {k}", "it") for k in range(5)], "doc_id long, text string, lang string")
    assert {r.word_distance for r in quality_rules.judge(docs).collect()} == {None}


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog of the house", "en", "s", "mine")], "doc_id long, text string, lang string, source string, uid string")
    assert [r.uid for r in langid.drop_unidentified(docs, ("en",)).collect()] == ["mine"]
    odd = docs.withColumn("__text", docs["uid"]).withColumn("_text", docs["uid"]).withColumn("cut", docs["uid"])
    got = bpe.encode(odd, corpus_pipeline.VOCABULARY, corpus_pipeline.public_tokenizers.PATTERN).first()
    assert got["__text"] == "mine" and len(got.ids) > 3
    assert repeats.cut_repeats(odd).first().cut == "mine"
    assert html_text.extract(odd.withColumnRenamed("text", "html")).first().source == "s"


def test_covariance_weights_come_from_training_folds(spark):
    """Fold sums give the models of a direct fit, and rows that are held out have no say."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = {r.doc_id: r.score for r in quality_model.score(docs, labels).collect()}
    turned = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_model.score(docs, turned).collect()}
    assert first.keys() == again.keys() and all(abs(first[k] - again[k]) < 1e-9 for k in first)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(3, 1, (80, 10)), rng.normal(4, 2, (60, 10))])
    y = np.repeat([0, 1], [80, 60])
    fields = ", ".join(f"{name} double" for name in quality_model.FEATURES)
    table = [(k, *map(float, r), int(c)) for k, (r, c) in enumerate(zip(x, y))]
    rows = spark.createDataFrame(table, f"doc_id long, {fields}, label int").withColumn("fold", F.expr("int(doc_id % 5)"))
    centre, folds = quality_model.grouped_sums(rows)
    tried = quality_model.trials(rows, centre, folds)
    wrong = dict.fromkeys(range(len(quality_model.WEIGHTS)), 0)
    for f in range(5):
        mine = np.arange(140) % 5 == f
        parts = [x[(y == c) & ~mine] for c in (0, 1)]
        shares = np.array([len(p) for p in parts]) / (~mine).sum()
        covs = [np.cov(p.T, bias=True) for p in parts]
        pooled = shares[0] * covs[0] + shares[1] * covs[1]
        scale = np.sqrt(np.diag(pooled))
        for k, (a, b) in enumerate(quality_model.WEIGHTS):
            logs = []
            for p, cov in zip(parts, covs):
                own = ((1 - a) * cov + a * pooled) / np.outer(scale, scale)
                own = (1 - b) * own + b * np.trace(own) / 10 * np.eye(10)
                z = (x[mine] - p.mean(axis=0)) / scale
                logs.append(-0.5 * (z * np.linalg.solve(own, z.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(own)[1])
            margin = (logs[1] - logs[0]) / quality_model.TEMPERATURE + np.log(shares[1] / shares[0])
            wrong[k] += int(((1 / (1 + np.exp(-margin)) >= 0.3) != (y[mine] == 1)).sum())
    assert {k: w for w, _, k in tried} == wrong
