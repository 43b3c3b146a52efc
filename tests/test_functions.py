"""Hand-computed cases of the column functions, with the words and signs that the driver's tables lack."""

from pyspark.sql import functions as F

from ledgerlink.functions import money, text, times
from ledgerlink.operators import facts, rules


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_money(spark):
    assert column(spark, ["￥1,234.50元", "+5", "abc", "", "¥ 7"], money.first_number) == ["1234.50", "+5", "", "", "7"]
    assert column(spark, ["1,234.5", "12,34", "+5", "1.234", "", "x"], money.money_token) == ["1234.5", "1234", "+5", "", "", ""]
    assert [str(x) for x in column(spark, ["1.005", "1.015", "2.5", "0"], lambda c: money.quantize_money(money.parse_decimal(c)))] == ["1.00", "1.02", "2.50", "0.00"]
    assert column(spark, ["1_000", "abc", " "], money.parse_decimal) == [None, None, None]


def test_direction(spark):
    assert column(spark, ["收入", "收", "支出", "支", "不计收支"], money.statement_direction) == ["inflow", "inflow", "outflow", "outflow", "unknown"]
    assert column(spark, ["退款入账", "消费支出", "转入后付款", "其他"], money.sentence_direction) == ["inflow", "outflow", "inflow", "unknown"]
    # an unknown direction with a positive amount becomes an inflow
    assert column(spark, ["5", "-5", "0", "x"], lambda c: money.normalize_direction(F.lit("unknown"), money.parse_decimal(c))) == ["inflow", "outflow", "unknown", "unknown"]


def test_keys_and_tails(spark):
    assert column(spark, ["A　b C\n"], text.text_key) == ["abc"]
    assert column(spark, ["招行(1234)", "卡号: 62220000991", "账号 *8812", "无"], text.account_tail) == ["1234", "0991", "8812", ""]
    assert column(spark, ["尾号为 1234 的卡", "无"], text.mail_account_tail) == ["1234", ""]


def test_ids_follow_sorted_json(spark):
    import hashlib
    import json

    value = 'a"b\\c 中'
    want = "x_" + hashlib.sha256(json.dumps({"b": value, "a": "1"}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:20]
    assert column(spark, [value], lambda c: text.stable_id("x_", {"b": c, "a": F.lit("1")})) == [want]


def test_times(spark):
    assert column(spark, ["2024-1-5", "2024/01/05", "2024-01-05 10:11", "x", ""], lambda c: times.parse_datetime(c).cast("string")) == ["2024-01-05 00:00:00", "2024-01-05 00:00:00", "2024-01-05 10:11:00", None, None]
    assert column(spark, ["2024/01/05", "2024-01-05"], lambda c: times.ledger_date(c).cast("string")) == [None, "2024-01-05"]
    assert column(spark, ["付款2024-01-05", "on 2024/01/05,"], times.extract_date) == ["", "2024-01-05"]
    assert column(spark, ["2024年1月5日 9:08", "1月5日 19:08:07", "x"], lambda c: times.extract_datetime(c, F.lit(2023))) == ["2024-01-05 09:08:00", "2023-01-05 19:08:07", ""]
    assert column(spark, ["20240105", "2024.01.05", "0105"], times.compact_date) == ["2024-01-05", "2024-01-05", "0105"]


def test_mojibake(spark):
    broken = "工商银行".encode("gbk").decode("latin1")
    assert column(spark, [broken, "plain", "工商"], text.repair_mojibake) == ["工商银行", "plain", "工商"]


def test_model_replies(spark):
    replies = ['{"a": "}"}', '```json\n{"a": 1}\n```', 'so: {"a": {"b": "{"}} end', "none", "{open"]
    assert column(spark, replies, text.model_object) == ['{"a": "}"}', '{"a": 1}', '{"a": {"b": "{"}}', None, None]


def test_platform_and_channel(spark):
    assert column(spark, ["京东 TMALL", "大众点评", "x"], facts.infer_platform) == ["taobao", "meituan", ""]
    assert column(spark, ["财付通", "支付宝 微信", "美团月付", "x"], facts.payment_channel) == ["wechat_pay", "alipay", "meituan_credit", "bank_card"]


def test_every_category_rule_and_default(spark):
    table = rules.numbered(rules.CATEGORY_RULES)
    assert len(table) == 25
    rows = [(r["pos"], k, r["direction"] or "unknown", r["reason"]) for r in table for k in r["keywords"][:1]]
    rows += [(100, "x", "inflow", "金额流入但未命中明确收入规则"), (101, "x", "outflow", "金额流出但未命中支出分类规则"), (102, "x", "unknown", "无法判断资金方向")]
    df = spark.createDataFrame([(i, k, d) for i, k, d, _ in rows], "pos int, summary string, direction string")
    got = {r.pos: r.reason for r in rules.classify(df).collect()}
    for i, keyword, direction, reason in rows:
        by_priority = [r for r in sorted(table, key=lambda r: (r["priority"], r["pos"])) if r["direction"] in (None, direction) and any(k in keyword for k in r["keywords"])]
        assert got[i] == (by_priority[0]["reason"] if by_priority else reason)


def test_a_keyword_may_span_two_fields(spark):
    df = spark.createDataFrame([("星巴", "克", "outflow")], "merchant string, summary string, direction string")
    assert rules.classify(df).first().category_lv2 == "饮品零食"
