from pyspark.sql import functions as F

from lexispark.operators import dialog as dg

TALKS = [
    ("a", 0, ["INFORM"]), ("a", 1, ["NOOFFER", "REQUEST"]), ("a", 2, ["INFORM"]), ("a", 3, ["INFORM"]), ("a", 4, ["REQUEST"]),
    ("a", 5, ["INFORM", "REQMORE"]), ("a", 6, ["BYE"]), ("a", 7, ["BYE"]),
    ("b", 0, ["INFORM"]), ("b", 1, ["INFORM", "SELECT"]), ("b", 2, ["REQUEST"]),
]


def test_act_graph_and_context(spark):
    df = spark.createDataFrame(TALKS, "d string, t int, acts array<string>")
    edges = {(r.src, r.dst): r.n for r in dg.act_graph(df, "d", "t", "acts").collect()}
    assert edges["INFORM", "INFORM"] == 2 and edges["INFORM", "REQUEST"] == 3 and edges["BYE", "BYE"] == 1
    assert edges["SELECT", "REQUEST"] == 1
    fans = {r.node: (r.out_fan, r.in_fan) for r in dg.act_degrees(dg.act_graph(df, "d", "t", "acts")).collect()}
    assert fans["NOOFFER"] == (1, 1)
    prev = {(r.d, r.t): r.prev_acts for r in dg.previous_context(df, "d", "t", "acts").collect()}
    assert prev["a", 0] == "" and prev["a", 3] == "INFORM NOOFFER REQUEST INFORM" and prev["b", 2] == "INFORM INFORM SELECT"


def test_last_turn_of_a_run_is_kept(spark):
    df = spark.createDataFrame(
        [("c", 1, 10, 11, "Bot", " x "), ("c", 2, 12, 13, "Bot", ""), ("c", 3, 14, 15, "Me", "y"), ("c", 4, 16, 17, "Bot", "z")],
        "d string, t int, s int, e int, who string, text string",
    )
    out = dg.merge_runs(df, ["d"], ["t"], F.floor(F.col("t") / 2), "who", "s", "e", "text").orderBy("start").collect()
    assert [(r.who, r.start, r.end, r.text) for r in out] == [("Bot", 10, 13, "x"), ("Me", 14, 15, "y"), ("Bot", 16, 17, "z")]


def test_bio_both_ways(spark):
    text = "I want a cheap hotel, in north Cambridge please"
    spans = [(9, 14, "price"), (25, 40, "area")]
    df = spark.createDataFrame([(1, text, spans)], "id int, u string, spans array<struct<start:int,end:int,slot:string>>")
    row = dg.bio_from_spans(df, ["id"], "u", "spans").first()
    assert dict(zip(row.tokens, row.labels))["Cambridge"] == "I-AREA"
    assert row.labels == ["O", "O", "O", "B-PRICE", "O", "O", "B-AREA", "I-AREA", "O"]
    back = dg.spans_from_bio(spark.createDataFrame([(1, row.labels)], "id int, labels array<string>"), ["id"])
    assert sorted((r.start, r.end, r.type) for r in back.collect()) == [(3, 3, "PRICE"), (6, 7, "AREA")]


def test_orphan_inside_mark_is_no_span(spark):
    df = spark.createDataFrame([(1, ["I-X", "O", "B-Y", "I-Y"])], "id int, labels array<string>")
    assert [(r.start, r.end, r.type) for r in dg.spans_from_bio(df, ["id"]).collect()] == [(2, 3, "Y")]


def test_merge_spans_and_votes(spark):
    df = spark.createDataFrame([(1, 0, 3, "A"), (1, 4, 6, "A"), (1, 8, 9, "A"), (1, 9, 12, "B")], "d int, start int, end int, label string")
    got = sorted((r.start, r.end, r.label) for r in dg.merge_spans(df, ["d"]).collect())
    assert got == [(0, 6, "A"), (8, 9, "A"), (9, 12, "B")]
    votes = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (2, 5), (2, 4)], "g int, v int")
    assert sorted((r.g, r.v) for r in dg.majority_vote(votes, "g", "v").collect()) == [(1, 2), (2, 4)]
    moods = spark.createDataFrame([(["b", "a", "b"],), (["b", "a"],), ([],)], "m array<string>")
    assert [r.x for r in moods.select(dg.majority(F.col("m")).alias("x")).collect()] == ["b", "a", "NA"]
