"""Preference formatting against a plain loop, on odd rows, and without Python in the plan."""

from pyspark.sql import functions as F

from rankloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"), (1, 4, "assistant", "so long"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "été \U0001f600"), (2, 1, "assistant", "été \U0001f600"),
    (3, 0, "user", None), (3, 1, None, "x"), (3, None, "user", "first"),
    (4, 0, "assistant", ""), (5, 0, "user", "only"), (6, 0, "assistant", "r6"), (7, 0, "assistant", "r6"), (7, 1, "user", "end"),
    (9, 0, "assistant", "w " * 30_000), (None, 0, "user", "lost"),
]


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, set()).add((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    reply = {c: max((k for k, t in enumerate(v) if t[0] == "assistant"), default=None) for c, v in convs.items()}
    show = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)

    def spans(ts):
        at, out = 0, []
        for r, t in ts:
            begin = at + len("<|im_start|>") + len(r) + 1
            end = begin + len(t) + len("<|im_end|>")
            out += [(begin, end)] * (r == "assistant")
            at = end + 1
        return out

    out = {}
    for c, chosen in convs.items():
        rejected, k = list(chosen), reply[c]
        if k is not None:
            other = convs[c + 1][reply[c + 1]][1] if reply.get(c + 1) is not None else None
            rejected[k : k + 1] = [] if other is None else [("assistant", other)]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        out[c] = (n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), spans(chosen[n:]), spans(rejected[n:]))
    return out


def test_matches_a_plain_loop(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA).repartition(3)
    got = chat.format_pairs(chat.mismatched_pairs(chat.gather(rows)))
    assert got.columns == ["conv_id", "prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"]
    assert {r[0]: (*r[1:5], [tuple(s) for s in r[5]], [tuple(s) for s in r[6]]) for r in got.collect()} == brute(ROWS)


def test_spans_cut_out_replies(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA)
    row = chat.format_pairs(chat.mismatched_pairs(chat.gather(rows))).where("conv_id = 2").first()
    assert [row.chosen[s.begin : s.end] for s in row.chosen_spans] == ["été \U0001f600<|im_end|>"]


def test_own_pairs_keep_other_columns(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(7, [("user", "q")], [("user", "q"), ("assistant", "a")], "s"), (8, [], [], None)], f"pair long, chosen {turns}, rejected {turns}, source string")
    got = {r.pair: r for r in chat.format_pairs(pairs).collect()}
    assert got[7].prompt_turns == 1 and got[7].chosen == "" and got[7].rejected.endswith("a<|im_end|>\n") and got[7].source == "s"
    assert got[8].prompt == got[8].chosen == got[8].rejected == "" and got[8].chosen_spans == []


def test_empty_table_and_native_plan(spark):
    rows = spark.createDataFrame([], SCHEMA)
    got = chat.format_pairs(chat.mismatched_pairs(chat.gather(rows)))
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_spans_text(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit(1).alias("begin"), F.lit(3).alias("end")), F.struct(F.lit(5).alias("begin"), F.lit(9).alias("end"))).alias("s"))
    assert df.select(chat.spans_text(F.col("s"))).first()[0] == "1-3,5-9"


def test_names_that_clash_and_null_conversations(spark):
    turns = "array<struct<role:string,text:string>>"
    rows = [(7, "p", 3, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", None)]), (8, None, None, None, [("assistant", "c")]), (9, "q", 1, [], None)]
    got = chat.format_pairs(spark.createDataFrame(rows, f"_n long, prompt string, chosen_spans int, chosen {turns}, rejected {turns}"))
    assert got.columns == ["_n", "prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans"]
    found = {r["_n"]: (r.prompt_turns, r.prompt, r.chosen, r.rejected) for r in got.collect()}
    user, made = "<|im_start|>user\na<|im_end|>\n", lambda t: f"<|im_start|>assistant\n{t}<|im_end|>\n"
    assert found == {7: (1, user, made("b"), made("")), 8: (0, "", "", made("c")), 9: (0, "", "", "")}


def test_turns_are_gathered_once(spark, tmp_path):
    path = str(tmp_path / "turns")
    spark.createDataFrame([(k // 3, k % 3, "assistant" if k % 2 else "user", f"t{k}") for k in range(30)], "conv_id long, turn long, role string, text string").write.parquet(path)
    pairs = chat.format_pairs(chat.mismatched_pairs(chat.gather(spark.read.parquet(path))))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pairs.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and "Python" not in plan
