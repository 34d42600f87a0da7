import pytest
from pyspark.sql import functions as F

from gradeflow.functions import prompts
from gradeflow.functions import text as x
from gradeflow.functions import udfs
from gradeflow.operators import corpus as co
from gradeflow.operators import layout as lay
from gradeflow.operators import offers as o
from gradeflow.operators import quality as q
from gradeflow.operators import validate as v

PAIR = "instruction string, input string, output string"


@pytest.mark.parametrize("columns, layout", [
    (["instruction", "output", "messages"], "alpaca"), (["prompt", "completion", "question", "answer"], "openai"),
    (["messages", "question", "answer"], "chat"), (["question", "response", "answer"], "gsm8k"),
    (["question", "response"], "qa"), (["instruction"], "unknown"), ([], "unknown"),
])
def test_layout_priority(columns, layout):
    assert lay.detect_layout(columns) == layout


def test_conversion_keeps_blank_and_drops_empty(spark):
    rows = [("a", None, "b"), (" ", "", "b"), ("", "", "b"), ("a", "c", None), (None, None, None)]
    got = lay.to_alpaca(spark.createDataFrame(rows, PAIR)).collect()
    assert [tuple(r) for r in got] == [("a", "", "b"), (" ", "", "b")]
    unknown = lay.to_alpaca(spark.createDataFrame([("a",)], "text string"))
    assert unknown.columns == ["instruction", "input", "output"] and unknown.count() == 0
    forced = lay.to_alpaca(spark.createDataFrame([("q", "a", "r")], "question string, answer string, response string"), layout="qa")
    assert forced.first().output == "r"


def test_chat_takes_the_last_of_each_role(spark):
    talk = [("system", "s"), ("assistant", "a0"), ("user", "u1"), ("assistant", "a1"), ("user", "u2")]
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(talk)] + [(2, 0, "user", "alone")],
                                  "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in lay.chat_to_alpaca(turns).collect()] == [(1, "u2", "", "a1")]
    nested = lay.to_alpaca(lay.nest_turns(turns), keep=["conv_id"]).collect()
    assert [tuple(r) for r in nested] == [(1, "u2", "", "a1")]
    text = lay.render_chat_sections(turns.where("conv_id = 1 and turn < 3")).first().text
    assert text == "### System:\ns\n\n### Assistant:\na0\n\n### User:\nu1"


def test_sections_of_unknown_and_missing_roles(spark):
    df = spark.createDataFrame([([("tool", "x"), (None, "y")],)], "messages array<struct<role: string, content: string>>")
    assert df.select(prompts.chat_sections("messages")).first()[0] == "### User:\ny"


def test_prompt_branches(spark):
    one = lambda schema, row: lay.render_prompt(spark.createDataFrame([row], schema)).first().text
    assert one("instruction string", ("i",)) == "### Instruction:\ni\n\n### Input:\n\n\n### Response:\n"
    assert one("text string, prompt string, completion string", ("t", "p", "c")) == "t"
    assert one("prompt string, completion string", ("p", "c")) == "pc"
    with pytest.raises(ValueError):
        one("question string", ("q",))
    tricky = spark.createDataFrame([("{input}", "{output}", "x")], PAIR)
    assert lay.render_prompt(tricky, template="{instruction}|{input}|{output}").first().text == "{input}|{output}|x"


def test_training_text(spark):
    got = lay.format_training_text(spark.createDataFrame([("i", "c", "o")], PAIR)).first().text
    assert got == "<|im_start|>user\ni\n\nContext: c<|im_end|>\n<|im_start|>assistant\no<|im_end|>\n"
    rest = lay.format_training_text(spark.createDataFrame([("a", 1, "b")], "x string, y int, z string")).first().text
    assert rest == "a b"


@pytest.mark.parametrize("name, template", [
    ("Qwen/Qwen2.5", "chatml"), ("TinyLlama-1.1B", "llama-3"), ("microsoft/phi-3", "phi-3"), ("gpt2", "chatml"), (None, "chatml"),
])
def test_chat_template(spark, name, template):
    assert spark.createDataFrame([(name,)], "m string").select(prompts.chat_template_for("m")).first()[0] == template


@pytest.mark.parametrize("text, letter", [
    ("The answer is b.", "B"), ("Banana (c) d", "C"), ("xbx", "B"), ("", "A"), (None, "A"), ("zzz", "A"), ("a_ d", "D"),
])
def test_choice(spark, text, letter):
    assert spark.createDataFrame([(text,)], "t string").select(prompts.extract_choice("t")).first()[0] == letter


def test_required_columns(spark):
    df = spark.createDataFrame([("p", "c")], "prompt string, chosen string")
    with pytest.raises(ValueError, match="rejected"):
        lay.preference_pairs(df)
    assert lay.rl_queries(df).columns == ["query"]
    with pytest.raises(ValueError):
        lay.rl_queries(spark.createDataFrame([(1,)], "a int"))


def test_padding_masks_every_pad_id(spark):
    df = spark.createDataFrame([("x y z",), ("",)], "t string")
    rows = udfs.tokenize_with(df, "t", lambda t: [{"x": 7, "y": 0, "z": 9}[w] for w in t.split()], 5, 0).collect()
    got = sorted((r.input_ids, r.attention_mask, r.labels) for r in rows)
    assert got == [([0] * 5, [0] * 5, [-100] * 5), ([7, 0, 9, 0, 0], [1, 1, 1, 0, 0], [7, -100, 9, -100, -100])]
    cut = lay.tokenize_pad(spark.createDataFrame([("a b c d",)], "t string"), "t", 2).first()
    assert len(cut.input_ids) == 2 and cut.attention_mask == [1, 1]


def test_text_rules_equal_python(spark):
    import string

    samples = ["  A,b!  c d ", "", " x　", "don't", "tab\there\x1cend", "\x85", "ÉCOLE (x)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i long, t string")
    rows = df.select("i", x.normalize_answer("t").alias("n"), x.word_count("t").alias("w"), x.strip("t").alias("s"),
                     x.is_blank("t").alias("b")).collect()
    for r in rows:
        t = samples[r.i]
        plain = " ".join(t.lower().strip().translate(str.maketrans("", "", string.punctuation)).split())
        assert (r.n, r.w, r.s, r.b) == (plain, len(t.split()), t.strip(), not t.strip())


# validation

def test_issue_rows(spark):
    rows = [("a", "b", 0), (None, "b", 1), (" ", None, 2)]
    df = spark.createDataFrame(rows, "instruction string, output string, position long").withColumn("split", F.lit("train"))
    got = [(r.idx, r.issue) for r in v.format_issues(df).orderBy("idx", "check").collect()]
    assert got == [(1, "missing fields: instruction"), (1, "empty instruction"),
                   (2, "missing fields: output"), (2, "empty instruction"), (2, "empty output")]


def test_report_counts_the_rest(spark):
    df = spark.createDataFrame([("", "x", i, "train") for i in range(13)], "instruction string, output string, position long, split string")
    lines = [(r.line, r.message) for r in v.issue_report(v.format_issues(df)).orderBy("line").collect()]
    assert len(lines) == 11 and lines[-1] == (11, "... and 3 more issues")
    assert lines[0] == (1, "record 0: empty instruction")


def test_only_a_missing_split_is_invalid(spark):
    df = spark.createDataFrame([("", None, "", "train")] * 2, PAIR + ", split string")
    rows = {r.split: r for r in v.validation_report(df).collect()}
    assert rows["train"].valid and rows["train"].n_issues == 4 and rows["train"].n_duplicates == 1
    assert not rows["eval"].valid and rows["eval"].n is None


# user functions

def test_predictions_fall_back(spark):
    items = spark.createDataFrame([(i, "q", o, "m") for i, o in enumerate(["{'A': 'x'}", "{'A': 'y'}", "broken"])],
                                  "id long, question string, options string, meta_info string")

    def one(model, question, options, meta, phrases):
        return {"x": " c ", "y": "Z"}[options["A"]]

    got = {r.id: (r.predicted_idx, r.fallback) for r in udfs.batch_predict(items, lambda p: None, one).collect()}
    assert got == {0: ("C", False), 1: ("A", True), 2: ("A", True)}
    with pytest.raises(ValueError, match="meta_info"):
        udfs.batch_predict(items.drop("meta_info"), lambda p: None, one)


def test_answers_with_cap(spark):
    pairs = spark.createDataFrame([(i, f"i{i}", None, "o") for i in range(9)], "id long, instruction string, input string, output string")
    got = sorted(tuple(r) for r in udfs.answer_with(pairs, lambda i, c: i + c, max_samples=2).collect())
    assert got == [(0, "i0", "o"), (1, "i1", "o")]


# offers, quality, corpus

def test_offers(spark):
    rows = [(1, "g", 24, 2.0, 0.95), (2, "g", 24, 1.0, 0.5), (3, "h", 24, 3.0, 0.1), (4, "h", 24, 2.5, 0.2)]
    df = spark.createDataFrame(rows, "offer_id long, kind string, ram int, price double, reliability double")
    assert {r.kind: r.offer_id for r in o.best_offer(df, ["kind"]).collect()} == {"g": 1, "h": 4}
    assert o.best_offer(df, ["kind"], max_price=2.0, kind="g").first().offer_id == 1
    ram = spark.createDataFrame([(24564.0,), (80.0,)], "r double").select(o.vram_mb_to_gb(F.col("r"))).collect()
    assert [r[0] for r in ram] == [24.0, 80.0]


def test_format_flags(spark):
    df = spark.createDataFrame([("Fine.",), (" ",), ("```x.",), ("cut of",), ("bad �.",), ("»",)], "text string")
    got = [(r.is_empty, r.open_fence, r.truncated, r.malformed, r.compliant) for r in q.format_compliance(df).collect()]
    f, t = False, True
    assert got == [(f, f, f, f, t), (t, f, f, f, f), (f, t, f, f, f), (f, f, t, f, f), (f, f, f, t, f), (f, f, f, f, t)]


def test_page_text(spark):
    html = ("<html><head><title> A &amp; B </title><style>p{}</style></head><body><!-- x <p>no</p> --><nav>menu</nav>"
            "<SCRIPT type='a'>var t='<p>';</SCRIPT><p>One&nbsp;two</p>three &lt;b&gt;</body></html>")
    row = co.extract_page_text(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first()
    assert (row.title, row.text) == ("A & B", "One two three <b>")


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (200, 1), (201, 2), (350, 2), (351, 3), (500, 3)])
def test_chunks_cover_the_text(spark, n, chunks):
    words = [f"w{i}" for i in range(n)]
    rows = co.chunk_text(spark.createDataFrame([(1, " ".join(words))], "id long, text string"), "id").orderBy("chunk").collect()
    assert len(rows) == chunks
    covered = []
    for r in rows:
        part = r.text.split()
        assert part == words[r.chunk * 150:r.chunk * 150 + 200]
        covered += part
    assert set(covered) == set(words)


def test_subword_ids_equal_the_tokenizer(spark):
    """Whole texts are encoded, then cut and padded."""
    from tokenizers import Tokenizer

    from gradeflow.functions.subwords import tokenizer_file

    path = tokenizer_file("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["", None, "Hello world", "Ünïcode 中文 " * 50, "a b " * 3000, "<|endoftext|> x", "one"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    for name in (path, "byte_bpe_50k.json"):
        rows = lay.tokenize_pad(df, "t", 40, keep=["id"], pad_id=7, tokenizer=name).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = whole.encode(texts[r.id] or "", add_special_tokens=False).ids[:40]
            assert r.input_ids == ids + [7] * (40 - len(ids)) and sum(r.attention_mask) == len(ids)
            assert r.labels == [-100 if i == 7 else i for i in r.input_ids]


def test_subwords_of_a_given_table(spark):
    import hashlib

    from tokenizers import Tokenizer

    from gradeflow.functions.subwords import tokenizer_file
    from gradeflow.plans import catalog, q_pairs

    whole = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in catalog.QUERIES["tokenize_subwords"](spark, folder).collect():
        ids = whole.encode(texts.pop(r.doc_id) or "", add_special_tokens=False).ids[: q_pairs.MAX_LENGTH]
        padded = ",".join(map(str, ids + [0] * (q_pairs.MAX_LENGTH - len(ids))))
        assert (r.n_tokens, r.id_sum, r.ids_md5) == (len(ids), sum(ids), hashlib.md5(padded.encode()).hexdigest())
    assert not texts


def test_answers_leave_references_out_of_python(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"é{i}", None if i % 5 == 0 else "x", None if i % 3 == 0 else "long " * 50) for i in range(1000)]
    pairs = spark.createDataFrame(rows, "id long, instruction string, input string, output string").coalesce(2)
    out = udfs.answer_with(pairs, lambda i, c: None if i == "é1" else f"{i}|{c}")
    # only the two texts that the generator reads are inputs of the Python step
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPython" in plan
    got = {r.id: (r.prediction, r.reference) for r in out.collect()}
    assert got == {i: (None if a == "é1" else f"{a or ''}|{c or ''}", o or "") for i, a, c, o in rows}
    assert udfs.answer_with(pairs.limit(0), lambda i, c: i).count() == 0
