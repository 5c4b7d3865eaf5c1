"""The registered queries of the library and their SQL. Every query reads whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, detectors, fixed, spans
from ..operators import assemble, history, redact, reports, review, terms
from ..sources.files import spread

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digits(column, n):
    return F.lpad(column.cast("string"), n, "0")


# --- documents -------------------------------------------------------------------------------------


def redact_documents(spark, sf_dir):
    """The flagship job over all documents."""
    done = redact.redact(spread(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "doc_type", F.size("matches").cast("long").alias("n_matches"), F.length("redacted").cast("long").alias("n_redacted"), F.sha2("redacted", 256).alias("redacted_sha256"))


def _rule_hits(rule_id):
    rule = next(r for r in fixed.DETECTORS if r[0] == rule_id)

    def run(spark, sf_dir):
        hits = spans.scan(F.col("text"), rule[2], rule[3])
        return table(spark, sf_dir, "documents").select("doc_id", F.size(hits).cast("long").alias("n_hits"), F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["start"].cast("string"), h["value"])), "|").alias("hits"))

    return run


def _rule_sql(pattern):
    marked = f"regexp_split_to_array(regexp_replace(text, '{pattern}', '﷐\\0﷐', 'g'), '﷐')"
    return f"""
WITH p AS (SELECT doc_id, {marked} AS parts FROM documents),
q AS (SELECT doc_id, list_filter(list_transform(parts, lambda x, i: {{'i': i, 'v': x, 'at': length(array_to_string(parts[1:i-1], ''))}}), lambda y: y.i % 2 = 0) AS h FROM p)
SELECT doc_id, len(h) AS n_hits, array_to_string(list_transform(h, lambda y: y.at || ':' || y.v), '|') AS hits FROM q"""


def admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("file_name", F.element_at(F.array(*map(F.lit, ("a.md", "b.PDF", "c.doc", "d.txt", "e.markdown", "f.docx"))), (F.col("doc_id") % 6 + 1).cast("int"))).withColumn("n_bytes", F.col("n_chars") * 1500)
    return redact.admitted(docs).select("doc_id", "reject_reason")


ADMISSION_SQL = f"""
WITH d AS (SELECT doc_id, text, n_chars * 1500 AS b, ['md', 'pdf', 'doc', 'txt', 'markdown', 'docx'][doc_id % 6 + 1] AS e FROM documents)
SELECT doc_id, CASE WHEN e = 'doc' THEN 'legacy format' WHEN e = 'txt' THEN 'unknown format'
  WHEN b > CASE e WHEN 'pdf' THEN {fixed.PDF_BYTES} ELSE {fixed.MARKDOWN_BYTES} END THEN 'too many bytes'
  WHEN length(text) > {fixed.TEXT_CHARS} THEN 'too many characters' WHEN trim(text, e' \\t\\n\\r') = '' THEN 'no text' END AS reject_reason
FROM d"""


def normalise(spark, sf_dir):
    dirty = F.concat(F.lit(" \n"), F.regexp_replace("text", "\\. ", ". \t\r\n\r\r\n\n"), F.lit("\r"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redact.normalised(dirty), 256).alias("text_sha256"))


NORMALISE_SQL = r"""
WITH d AS (SELECT doc_id, e' \n' || replace(text, '. ', e'. \t\r\n\r\r\n\n') || e'\r' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\t ]+\n', chr(10), 'g') AS t FROM d)
SELECT doc_id, sha256(trim(regexp_replace(t, '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), e' \t\n\r')) AS text_sha256 FROM a"""


def custom_terms(spark, sf_dir):
    found = detectors.term_candidates(F.col("text"), detectors.parsed_terms("the\n、License;stupid"))
    counts = F.transform(F.array(*[F.lit(f"【敏感信息{i}】") for i in (1, 2, 3)]), lambda p: F.size(F.filter(found, lambda c: c["placeholder"] == p)))
    return table(spark, sf_dir, "documents").select("doc_id", *[F.get(counts, F.lit(i)).cast("long").alias(f"n_{i + 1}") for i in range(3)])


CUSTOM_TERMS_SQL = "SELECT doc_id, " + ", ".join(f"(length(text) - length(replace(text, '{t}', ''))) // {len(t)} AS n_{i}" for i, t in enumerate(("the", "License", "stupid"), 1)) + " FROM documents"


# --- contracts from customers: golden by construction ------------------------------------------------

HEADS = {"AUTOMOBILE": ("授权委托书", "mandate"), "BUILDING": ("授权书", "authorization"), "FURNITURE": ("技术开发合同", "tech"), "HOUSEHOLD": ("货物采购合同", "purchase"), "MACHINERY": ("情况说明函", "letter")}


def contracts(spark, sf_dir):
    c = spread(table(spark, sf_dir, "customer"))
    key = F.col("c_custkey")
    head = F.element_at(F.create_map(*[F.lit(x) for k, v in HEADS.items() for x in (k, v[0])]), F.col("c_mktsegment"))
    text = F.concat(
        F.lit("# "), head, F.lit("\n\n甲方：测试"), _digits(key, 6), F.lit("有限公司（以下简称“测试"), _digits(key, 6), F.lit("”）\n乙方：样例研究中心\n"),
        F.lit("合同编号：HT-"), _digits(key, 6), F.lit("\n联系电话：138"), _digits(key, 8), F.lit("\n邮箱：u"), key.cast("string"), F.lit("@example.com\n身份证号：110101199001"), _digits(key, 6),
        F.lit("\n\n## 第一条 价款\n\n测试"), _digits(key, 6), F.lit("负责设计，测试"), _digits(key, 6), F.lit("有限公司负责验收。费用为"), key.cast("string"), F.lit("元，税率为"), (key % 30).cast("string"), F.lit("%，阶段付款比例为30%-40%。\n有效期自[2026.01.01]至[2026.12.31]，期限共12个月，应在"),
        (key % 48 + 1).cast("string"), F.lit("小时内响应，交付日期为2026年3月1日。"),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), "c_mktsegment", text.alias("text"))


def redact_contracts(spark, sf_dir):
    return redact.redact(contracts(spark, sf_dir)).select("doc_id", "doc_type", "redacted")


_TYPE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in HEADS.items()) + " END"
_HEAD = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in HEADS.items()) + " END"
REDACT_CONTRACTS_SQL = f"""
SELECT c_custkey AS doc_id, {_TYPE} AS doc_type,
  '# ' || {_HEAD} || e'\\n\\n甲方：【主体A】（以下简称“【主体A简称】”）\\n乙方：【主体B】\\n合同编号：【文档编号】\\n联系电话：【联系方式已删除】\\n邮箱：【邮箱已删除】\\n身份证号：【身份证号已删除】'
  || e'\\n\\n## 第一条 价款\\n\\n【主体A简称】负责设计，【主体A】负责验收。费用为X元，税率为X%，阶段付款比例为X%-Y%。\\n有效期自[20XX年XX月XX日]至[20XX年XX月XX日]，期限共X个月，应在Y小时内响应，交付日期为20XX年XX月XX日。' AS redacted
FROM customer"""


def late_term(spark, sf_dir):
    """Terms added to detected matches: one apart from them, and one that begins before a match and so takes its place."""
    docs = redact.matched(redact.detected(redact.admitted(contracts(spark, sf_dir)).drop("reject_reason")))
    done = redact.replaced(redact.with_late_term(redact.with_late_term(docs, " 负责 "), "交付日期为2026"))
    return done.select("doc_id", F.size("matches").cast("long").alias("n_matches"), "redacted")


LATE_TERM_SQL = f"""WITH r AS ({REDACT_CONTRACTS_SQL})
SELECT doc_id, CAST(19 AS BIGINT) AS n_matches, replace(replace(redacted, '负责', '【敏感信息】'), '交付日期为20XX年XX月XX日', '【敏感信息】年3月1日') AS redacted FROM r"""


# --- both outcomes of admission, and tables of terms ---------------------------------------------------


def unsettled_documents(spark, sf_dir):
    """Documents of which some are blank, hold reserved characters, are too long or of other formats."""
    d, kind = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    text = F.when(kind == 1, " \n\t　\n").when(kind == 2, F.concat(F.lit("a﷐b "), "text")).when(F.col("doc_id") % 50 == 3, F.rpad("text", fixed.TEXT_CHARS + 1, "x")).when(kind == 5, F.concat(F.lit("邮箱：u"), F.col("doc_id").cast("string"), F.lit("@example.com。"))).otherwise(F.col("text"))
    name = F.when(kind == 7, "x.DOC").when(kind == 8, "x.txt").otherwise("x.md")
    return spread(d.select("doc_id", text.alias("text"), name.alias("file_name")))


UNSETTLED_SQL = f"""CASE WHEN doc_id % 10 = 7 THEN 'legacy format' WHEN doc_id % 10 = 8 THEN 'unknown format' WHEN doc_id % 50 = 3 THEN 'too many characters'
  WHEN doc_id % 10 = 1 OR (doc_id % 10 NOT IN (2, 5) AND trim(text, e' \\t\\n\\r') = '') THEN 'no text' WHEN doc_id % 10 = 2 THEN 'reserved characters' END"""
_OUTCOMES_SQL = f"""WITH d AS (SELECT *, {UNSETTLED_SQL} AS reject_reason FROM documents)
SELECT doc_id, CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, reject_reason, CASE WHEN doc_id % 10 = 5 THEN '邮箱：【邮箱已删除】。' END AS redacted FROM d"""


def _outcome_rows(done):
    """Of accepted texts only those are shown whose redaction SQL can tell."""
    return done.select("doc_id", "outcome", "reject_reason", F.when(F.col("doc_id") % 10 == 5, F.col("redacted")).alias("redacted"))


def quarantine(spark, sf_dir):
    """Every document in exactly one of two sinks, written by one pass and read back."""
    path = f"{_shared(spark)}/outcomes"
    redact.write_outcomes(unsettled_documents(spark, sf_dir), path)
    return _outcome_rows(spark.read.parquet(path))


def stream_quarantine(spark, sf_dir):
    """The same from a stream of the documents."""
    from ..streaming import jobs

    out = _shared(spark)
    unsettled_documents(spark, sf_dir).write.parquet(f"{out}/in")
    schema = spark.read.parquet(f"{out}/in").schema
    jobs.outcome_stream(jobs.read_stream(spark, f"{out}/in", schema), f"{out}/outcomes", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return _outcome_rows(spark.read.parquet(f"{out}/outcomes"))


def term_table(spark, sf_dir):
    """Hits of a table of terms (all names of customers, parts and suppliers, and the customers' segments) in texts that hold some of them."""
    names = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("term")).distinct()
    # Numbered by place in the sorted list; the table of terms is what is broadcast, so one task may number it.
    every = names("customer", "c_name").union(names("part", "p_name")).union(names("supplier", "s_name")).union(names("customer", "c_mktsegment")).distinct()
    listed = every.groupBy().agg(F.array_sort(F.collect_list("term")).alias("l")).select(F.posexplode("l").alias("i", "term")).select((F.col("i") + 1).alias("term_no"), "term")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws("; ", "c_mktsegment", "c_name", "c_name", F.lit("no term"), F.substring("c_name", 1, 12)).alias("text"))
    found = terms.with_terms(docs, listed, "found", folder=_shared(spark))
    return found.select("doc_id", F.array_join(F.transform("found", lambda c: F.concat_ws(":", c["start"].cast("string"), c["value"], c["placeholder"])), "|").alias("hits"))


TERM_TABLE_SQL = """
WITH t AS (SELECT term, row_number() OVER (ORDER BY term) AS no FROM (SELECT c_name AS term FROM customer UNION SELECT p_name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_mktsegment FROM customer)),
d AS (SELECT c_custkey AS doc_id, c_mktsegment || '; ' || c_name || '; ' || c_name || '; no term; ' || c_name[1:12] AS text FROM customer),
p AS (SELECT doc_id, no, term, string_split(text, term) AS parts FROM d JOIN t ON contains(text, term)),
h AS (SELECT doc_id, no, term, unnest(list_transform(parts[1:len(parts) - 1], lambda x, i: list_sum(list_transform(parts[1:i], lambda y: length(y))) + (i - 1) * length(term))) AS st FROM p)
SELECT d.doc_id, coalesce(string_agg(st || ':' || term || ':【敏感信息' || no || '】', '|' ORDER BY no, st), '') AS hits FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id"""


def classify_contracts(spark, sf_dir):
    kind = classify.document_type(F.col("text"))
    return contracts(spark, sf_dir).select("doc_id", kind.alias("doc_type"), classify.type_name(F.col("text"), kind).alias("type_name"), F.length(reports.analysis_prompt(kind)).cast("long").alias("prompt_chars"), reports.export_name(kind, F.lit(False)).alias("export_name"))


_LABEL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{fixed.TYPES[v[1]]}'" for k, v in HEADS.items()) + " END"
CLASSIFY_SQL = f"""
SELECT c_custkey AS doc_id, {_TYPE} AS doc_type, CASE WHEN {_TYPE} IN ('tech', 'purchase') THEN {_HEAD} ELSE {_LABEL} END AS type_name,
  CAST({sum(map(len, fixed.PROMPT))} + length({_LABEL}) + CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN {len(fixed.FOCUS[v[1]])}" for k, v in HEADS.items())} END AS BIGINT) AS prompt_chars,
  {_LABEL} || '_脱敏版.md' AS export_name
FROM customer"""

# Lines of a contract, one or two for each rule, with what they become; {k} is the customer's key in six digits.
RULE_LINES = [
    ("D03", "信用代码91310{k}MA1K4B2。", "信用代码【统一社会信用代码已删除】。"),
    ("D05", "座机（021）5555 1234（转 8）。", "座机【联系方式已删除】。"),
    ("D06", "账户6222 0210 00{k}。", "账户【银行账号已删除】。"),
    ("D07", "签署于【2026】年【3】月【15】日。", "签署于20XX年XX月XX日。"),
    ("D08", "合计人民币大写：壹佰元整。", "合计【金额】。"),
    ("D09", "报酬￥1,234（大写：壹仟元整）。", "报酬【金额】。"),
    ("D11", "单笔≥5{k}万元。", "单笔≥X万元。"),
    ("D12", "押付USD 3000。", "押付【金额】。"),
    ("D13", "酬金【350】元。", "酬金【金额】。"),
    ("D14", "系数[12.50]。", "系数【金额】。"),
    ("D15", "折合【壹佰元整】。", "折合【金额】。"),
    ("D16", "计（港币伍佰元整）。", "计【金额】。"),
    ("D17", "按22元/㎡/月计。", "按X元/㎡/月计。"),
    ("D18", "收（88）元。", "收（X）元。"),
    ("D19", "定金港币伍佰元整。", "定金【金额】。"),
    ("D20", "报价100-200元。", "报价X-Y元。"),
    ("D23", "占百分之 15。", "占百分之X。"),
    ("D24", "费率2‰-3‰。", "费率X‰-Y‰。"),
    ("D25", "收{k}‰。", "收X‰。"),
    ("D26", "占千分之三。", "占千分之X。"),
    ("D27", "占比三分之二。", "占比X分之Y。"),
    ("D28", "约定一半。", "约定【比例】。"),
    ("D29", "其3 × 余款。", "其X × 余款。"),
    ("D30", "打八折。", "打X折。"),
    ("D31", "按分3期支付。", "按分X期支付。"),
    ("D32", "于第2期结清。", "于第X期结清。"),
    ("D33", "精度≥0.95。", "精度≥X。"),
    ("D34", "误差≤5mm。", "误差≤Xmm。"),
    ("D35", "长10至20cm。", "长X-Ycm。"),
    ("D36", "重不少于30kg。", "重不少于Xkg。"),
    ("D37", "面积3万平方米。", "面积X万平方米。"),
    ("D38", "功率 5kW。", "功率 XkW。"),
    ("D41", "于2026年3月生效。", "于20XX年XX月生效。"),
    ("D42", "逢8月31日交付。", "逢XX月XX日交付。"),
    ("D43", "需第1-2周完成。", "需第Y-Z周完成。"),
    ("D45", "余额1,234.50。", "余额【金额】。"),
    ("L02", "我方地址及电话：北京市海淀区测试路{k}号", "我方地址及电话：【地址及联系方式】"),
    ("L03", "丙方：地址：上海市测试路6号", "丙方：地址：【地址】"),
    ("L04", "注册地址：广州市测试大道9号", "注册地址：【地址】"),
    ("L05", "工程位于深圳市测试路3号，已开工", "工程位于【地址】，已开工"),
    ("L06", "收件人：【张三】", "收件人：【收件人】"),
    ("L07", "联系人及联系方式：李四 电话：13812345678", "联系人及联系方式：【联系人】 电话：【联系方式已删除】"),
    ("L08", "授权代表：王五，到场", "授权代表：【授权代表信息】，到场"),
    ("L09", "经办人：赵六；", "经办人：【联系人】；"),
    ("L10", "职务：销售总监", "职务：【人员信息】"),
    ("L11", "开户行及账号：测试支行{k}", "开户行【开户行已删除】"),
    ("L12", "开户银行：测试银行支行", "开户银行：【开户行已删除】"),
    ("L13", "金额大写：伍佰", "金额大写：【金额】"),
    ("L14", "保证金：5000", "保证金：【金额】"),
    ("L15", "违约金：伍佰", "违约金：【金额】"),
    ("L16", "范围：10-20", "范围：X-Y"),
    ("L17", "项目名称：测试系统{k}", "项目名称：【技术项目A】"),
    ("P1", "讲师：钱七、孙八。", "讲师：【人员姓名】、【人员姓名】。"),
    ("P2", "另有、周九律师到场。", "另有、【人员姓名】律师到场。"),
    ("P3", "我方指派本所吴十律师到场。", "我方指派本所【人员姓名】律师到场。"),
    ("V-ADDR", "注册地址：见下述地址", "注册地址：见下述地址"),
    ("V-PERS", "经办人：待填写；", "经办人：待填写；"),
    ("R3", "12.5%以上", "12.5%以上"),
    ("R3", "2026.03.01签署", "2026.03.01签署"),
]
ROLE_LINES = [
    ("E4", "委托人：测试甲{k}有限公司", "委托人：【主体A】"),
    ("E5", "受托人：测试乙{k}有限公司", "受托人：【主体B】"),
    ("E6", "收款方：测试丙{k}中心", "收款方：【相关主体】"),
    ("E10", "由【测试甲{k}有限公司】与测试乙{k}有限公司确认。", "由【主体A】与【主体B】确认。"),
    ("E8", "另见测试丙 {k}中 心。", "另见【相关主体】。"),
]
# Texts at the edge of a rule: what it must leave alone (no second text), and sentences that several rules share.
BOUNDARY_TEXTS = [
    ("邮箱u1@example，u1@b.c。",), ("工号12812345678在",), ("号138123456789在",), ("座机（0210）55 1234在",), ("卡号6222 02在",), ("人民币小写：壹佰",), ("USD为本币。",), ("第[a]元在",), ("系数[12.505]在",),
    ("计元/㎡/月。",), ("百分比%在",), ("百分之多在",), ("比‰在",), ("分之一在",), ("大半在",), ("3 × 数量在",), ("成交在",), ("分期支付在",), ("期满在",), ("≥若干在",), ("米制在",), ("版本2026.13.45在",), ("第一至二章在",), ("年月在",),
    ("合同编号：--",), ("注册地址：无",), ("职务：1",), ("大写：无",), ("保证金：无",), ("违约金：无",), ("范围：全部",), ("项目名称：A",), ("2. 完成工作",), ("（一）总则",), ("第3条 价款",), ("1.7 工作日：指日期。",),
    ("2.2组织刑事或行政打击的责任由违约方承担。",), ("所有通讯应发往相关接受方的下述地址、电邮地址、传真号码，或书面通知的其他地址、电邮地址。",), ("甲方不配合、主管机关要求额外说明而导致延误的，乙方不承担责任。",),
    ("共有5万平方米在", "共有X万平方米在"), ("违约金增加1万元（大写：壹万元），余款≥100万时按0.55×余款计算。", "违约金增加X万元，余款≥X万时按X×余款计算。"), ("逾期付款按合同总费用的0.3‰向乙方支付违约金。", "逾期付款按合同总费用的X‰向乙方支付违约金。"),
    ("服务期限为2个月（贰个月），乙方应在通知后【20】个工作日内补足资料。", "服务期限为Y个月，乙方应在通知后Y个工作日内补足资料。"), ("合同有效期为【2026】年【5】月【1】日至【2027】年【4】月【30】日。", "合同有效期为20XX年XX月XX日至20XX年XX月XX日。"),
    ("其中一半费用分（三期）支付，首期支付总额的三分之一。", "其中【比例】费用分X期支付，首期支付总额的X分之Y。"), ("合同价款为1，000，000（壹佰万元整）。", "合同价款为【金额】。"), ("费用大写：人民币[捌拾叁万肆仟肆佰叁拾壹玖角]。", "费用大写：【金额】。"),
    ("税率为6%，阶段付款比例为30%-40%，报价为$12,000，预算区间为100-200万元。", "税率为X%，阶段付款比例为X%-Y%，报价为【金额】，预算区间为X-Y万元。"), ("开票地址：东莞市长安镇示例社区东门中路168号。", "开票地址：【地址】"),
    ("收件人[刘示例]；电话13100000000；邮箱example@example.com。", "收件人【收件人】；电话【联系方式已删除】；邮箱【邮箱已删除】。"),
    ("光泽度要求50 – 120GU；粗糙度要求0.1 ~ 0.5μm；硬度要求>=3H；附着力要求0级；耐磨要求≥3000次；响应时间5 to 8ms；保密期0.5年。", "光泽度要求X-YGU；粗糙度要求X-Yμm；硬度要求>=XH；附着力要求X级；耐磨要求≥X次；响应时间X-Yms；保密期X年。"),
]
AMOUNT_LINES = [("V5", "费用为{k}元，税率为6%。", "费用为{k}元，税率为X%。"), ("V5", "押付USD 3000，共30天。", "押付USD 3000，共X天。")]


def _rendered(spark, sf_dir, head: str, lines: list[tuple[str, str, str]]):
    text = head + "".join("\n" + line for _, line, _ in lines)
    c = spread(table(spark, sf_dir, "customer"))
    return c.select(F.col("c_custkey").alias("doc_id"), F.replace(F.lit(text), F.lit("{k}"), _digits(F.col("c_custkey"), 6)).alias("text"))


def _rendered_sql(head: str, lines: list[tuple[str, str, str]]) -> str:
    want = (head + "".join("\n" + shown for _, _, shown in lines)).replace("'", "''")
    return f"SELECT c_custkey AS doc_id, replace('{want}', '{{k}}', lpad(c_custkey::VARCHAR, 6, '0')) AS redacted FROM customer"


def redact_rules(spark, sf_dir):
    """Every pattern, field and person rule on a line of its own."""
    return redact.redact(_rendered(spark, sf_dir, "技术开发合同", RULE_LINES)).select("doc_id", "redacted")


def redact_boundaries(spark, sf_dir):
    """What lies at the edge of a rule; each customer has one of the texts."""
    texts = F.array(*[F.lit("甲\n" + t[0]) for t in BOUNDARY_TEXTS])
    c = spread(table(spark, sf_dir, "customer"))
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.get(texts, (F.col("c_custkey") % len(BOUNDARY_TEXTS)).cast("int")).alias("text"))
    return redact.redact(docs).select("doc_id", "redacted")


BOUNDARIES_SQL = "SELECT c_custkey AS doc_id, [" + ", ".join(f"e'甲\\n{t[-1]}'" for t in BOUNDARY_TEXTS) + f"][c_custkey % {len(BOUNDARY_TEXTS)} + 1] AS redacted FROM customer"


def redact_roles(spark, sf_dir):
    """Declared roles, related entities, mentions in brackets and with blanks."""
    return redact.redact(_rendered(spark, sf_dir, "测试文件", ROLE_LINES)).select("doc_id", "redacted")


def keep_amounts(spark, sf_dir):
    """Amounts kept; text taken from PDF is headed by its warnings."""
    docs = _rendered(spark, sf_dir, "测试文件", AMOUNT_LINES).withColumns({"source_format": F.lit("pdf"), "warnings": F.array(F.lit("甲"), F.lit("乙"))})
    return redact.redact(docs, keep_amounts=True).select("doc_id", "redacted")


def manual_types(spark, sf_dir):
    """A label typed in by hand stands for the headings; the prompt and file name follow it."""
    manual = F.lit("专项授权委托书")
    kind = classify.document_type(F.col("text"), manual)
    docs = _rendered(spark, sf_dir, "技术开发合同", AMOUNT_LINES)
    return docs.select("doc_id", kind.alias("doc_type"), classify.type_name(F.col("text"), kind, manual).alias("type_name"), reports.analysis_prompt(kind).alias("prompt"), reports.export_name(kind, F.lit(True)).alias("export_name"))


MANUAL_SQL = f"""SELECT c_custkey AS doc_id, 'mandate' AS doc_type, '专项授权委托书' AS type_name,
  '{fixed.PROMPT[0]}委托书{fixed.PROMPT[1]}{fixed.FOCUS["mandate"]}{fixed.PROMPT[2]}' AS prompt, '委托书_PDF文字提取_脱敏版.md' AS export_name FROM customer"""

# --- spans from lineitem ------------------------------------------------------------------------------

_CATS = ("amount", "phone", "date", "person", "percentage", "duration", "numericSpec")


def span_documents(spark, sf_dir):
    """Matches by order, from line items: overlaps not yet settled."""
    x = table(spark, sf_dir, "lineitem")
    start = (F.col("l_suppkey") % 50).cast("int")
    cat = F.element_at(F.array(*map(F.lit, _CATS)), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    row = F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.lit("v").alias("value"), cat.alias("category"), F.lit("P").alias("placeholder"))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey"), row.alias("c"))))
    return x.groupBy(F.col("l_orderkey").alias("doc_id")).agg(rows.alias("r")).select("doc_id", F.transform("r", lambda r: r["c"]).alias("candidates"))


def resolve_spans(spark, sf_dir):
    taken = spans.resolved(F.col("candidates"), None)
    return span_documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(taken, lambda c: F.concat_ws("-", c["start"].cast("string"), c["end"].cast("string"), c["category"])), ",").alias("taken"))


_SPAN_SQL = f"""
s AS (SELECT l_orderkey AS doc_id, (l_suppkey % 50)::INTEGER AS st, (l_suppkey % 50)::INTEGER + l_quantity::INTEGER AS en, l_linenumber, l_partkey,
  {list(_CATS)}[(l_linenumber - 1) % 7 + 1] AS cat, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, st, en) AS seq FROM lineitem),
o AS (SELECT doc_id, list({{'st': st, 'en': en, 'cat': cat}} ORDER BY st, en DESC, CASE cat {' '.join(f"WHEN '{c}' THEN {fixed.PRIORITY[c]}" for c in _CATS)} END DESC, seq) AS l FROM s GROUP BY doc_id),
t AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN x.st >= a.e THEN {{'e': x.en, 'n': list_append(a.n, x)}} ELSE a END, {{'e': 0, 'n': l[1:0]}}).n AS taken FROM o)"""
RESOLVE_SQL = f"WITH {_SPAN_SQL} SELECT doc_id, array_to_string(list_transform(taken, lambda x: x.st || '-' || x.en || '-' || x.cat), ',') AS taken FROM t"


def settled(spark, sf_dir):
    """Settled matches of the orders, all selected."""
    docs = span_documents(spark, sf_dir).withColumn("candidates", spans.resolved(F.col("candidates"), None))
    return docs.select("doc_id", F.transform("candidates", lambda m: F.struct(spans.match_id(m).alias("match_id"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["category"].alias("category"), m["placeholder"].alias("placeholder"), F.lit(True).alias("selected"))).alias("matches"))


def decided(docs):
    """Every third start is kept, every fifth placeholder emptied."""
    each = docs.select("doc_id", F.explode("matches").alias("m"))
    return each.filter("m.start % 3 = 0 OR m.start % 5 = 0").select("doc_id", "m.match_id", F.expr("m.start % 3 <> 0").alias("selected"), F.expr("if(m.start % 5 = 0, '', NULL)").alias("placeholder"))


def reviewed(spark, sf_dir):
    """Settled matches with decisions."""
    docs = settled(spark, sf_dir)
    return review.with_decisions(docs, decided(docs))


_REVIEW_SQL = f"{_SPAN_SQL}, m AS (SELECT doc_id, i AS ordinal, x.st AS st, x.cat AS category, x.st % 3 <> 0 AS selected, CASE WHEN x.st % 5 = 0 THEN '【已删除】' ELSE 'P' END AS placeholder FROM (SELECT doc_id, u.x AS x, u.i AS i FROM (SELECT doc_id, unnest(list_transform(taken, lambda y, j: {{'x': y, 'i': j}})) AS u FROM t)))"


def review_matches(spark, sf_dir):
    return review.match_rows(reviewed(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "start", "category", "selected", "placeholder")


def batch_counts(spark, sf_dir):
    return review.batch_counters(reviewed(spark, sf_dir))


def batch_toggle(spark, sf_dir):
    docs = review.batch_toggled(review.batch_toggled(reviewed(spark, sf_dir), "time"), "time")
    return review.match_rows(docs).groupBy("doc_id").agg(F.count_if(~F.col("selected")).alias("n_kept"))


def select_all(spark, sf_dir):
    rows = review.match_rows(review.all_selected(reviewed(spark, sf_dir)))
    return rows.groupBy("doc_id").agg(F.count_if("selected").alias("n_selected"), F.count("*").alias("n_matches"))


def export_notes(spark, sf_dir):
    """The summary of an export (selected matches) and the note on retained risks."""
    chosen = F.size(F.filter("matches", lambda m: m["selected"]))
    docs = reviewed(spark, sf_dir).withColumns({"chosen": chosen, "risky": review.n_high_risk_kept(F.col("matches"))})
    return docs.select("doc_id", reports.export_summary(F.col("chosen"), F.col("doc_id") % 2 == 0).alias("summary"), reports.risk_note(F.col("risky")).alias("note"))


def risk_retained(spark, sf_dir):
    return review.high_risk_kept(reviewed(spark, sf_dir))


def report_counts(spark, sf_dir):
    rows = reports.label_counts(review.match_rows(reviewed(spark, sf_dir)))
    return rows.select("doc_id", "label", "n_selected", "n_kept", F.col("first_ordinal").cast("long").alias("first_ordinal"))


_CASE_LABEL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{fixed.CATEGORIES[c][0]}'" for c in _CATS) + " END"
_HIGH = ", ".join(f"'{c}'" for c in _CATS if fixed.CATEGORIES[c][2] == "high")
_GROUPS = ", ".join(f"('{g}', [{', '.join(repr(c) for c in cats)}])" for g, cats in fixed.BATCH_GROUPS.items())


def report_texts(spark, sf_dir):
    text = reports.report_text(F.concat(F.lit("JQ-"), F.col("doc_id").cast("string")), F.lit("v1"), F.lit("tech"), F.lit("2024-01-31 20:15:00").cast("timestamp"), F.col("matches"))
    return reviewed(spark, sf_dir).select("doc_id", text.alias("report"))


REPORT_SQL = f"""WITH {_REVIEW_SQL}, c AS (SELECT doc_id, {_CASE_LABEL} AS label, count(*) FILTER (selected) AS a, count(*) FILTER (NOT selected) AS b, min(ordinal) AS f FROM m GROUP BY ALL)
SELECT doc_id, e'# 脱敏报告\\n\\n- 摘要任务编号：JQ-' || doc_id || e'\\n- 工具版本：v1\\n- 文书类型：技术合作开发合同（自动识别）\\n- 处理时间：2024/2/1 04:15:00（UTC+8）\\n- 输出格式：Markdown\\n- 说明：本报告不记录任何原始敏感值。\\n\\n## 处理统计\\n\\n'
 || string_agg('- ' || label || '：已处理 ' || a || ' 处，用户保留 ' || b || ' 处', chr(10) ORDER BY f) || e'\\n\\n## 责任提示\\n\\n{fixed.DUTY}\\n' AS report
FROM c GROUP BY doc_id"""


# --- history from events -----------------------------------------------------------------------------


def _md5_id(column):
    h = F.md5(column.cast("string").cast("binary"))
    return F.concat(F.lit("JQ-"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def history_records(spark, sf_dir):
    return history_rows(table(spark, sf_dir, "events"))


def history_rows(e):
    cat = F.element_at(F.array(*map(F.lit, ("amount", "phone", "nope", "date"))), (F.col("event_id") % 4 + 1).cast("int"))
    count = lambda c, n: F.struct(c.alias("category"), n.cast("double").alias("replaced"), F.lit(1.0).alias("kept"))
    return e.select(
        (F.col("user_id") % 7).alias("client_id"), _md5_id(F.col("event_id") % 3001).alias("id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(F.col("event_id") % 11 == 0, "bad").otherwise("2024.01.02.3+0123456789").alias("version"), F.col("event_id").alias("pos"),
        F.array(count(cat, F.col("event_id") % 9 - 1), count(cat, F.lit(5)), count(F.lit("email"), F.lit(2))).alias("counts"),
    )


def clean_history(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("t")).first()["t"]
    return history_shown(history.cleaned(history_records(spark, sf_dir), F.lit(now)))


def history_shown(done):
    replaced, kept = history.totals(F.col("counts"))
    names = F.array_join(F.transform("counts", lambda c: c["category"]), ",")
    return done.select("client_id", "id", "pos", names.alias("categories"), replaced.alias("replaced"), kept.alias("kept"))


CLEAN_HISTORY_SQL = """
WITH e AS (SELECT *, user_id % 7 AS client_id, md5((event_id % 3001)::VARCHAR) AS h, max(ts) OVER () AS now FROM events),
v AS (SELECT client_id, 'JQ-' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, event_id AS pos, ts FROM e WHERE event_id % 11 <> 0 AND ts > now - INTERVAL 30 DAY),
n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY client_id, id ORDER BY ts DESC, pos) = 1),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, pos) <= 100)
SELECT client_id, id, pos,
  CASE WHEN pos % 4 = 2 OR pos % 9 = 0 THEN 'email' ELSE ['email,amount', 'email,phone', '', 'email,date'][pos % 4 + 1] END AS categories,
  2 + CASE WHEN pos % 4 = 2 OR pos % 9 = 0 THEN 0 ELSE pos % 9 - 1 END AS replaced,
  1 + CASE WHEN pos % 4 = 2 OR pos % 9 = 0 THEN 0 ELSE 1 END AS kept FROM t"""


def history_deleted(spark, sf_dir):
    """Records without those deleted one by one, cleared clients and clients that opted out."""
    records = history_records(spark, sf_dir)
    gone = records.filter("pos % 5 = 0").select("client_id", "id").unionByName(records.filter("client_id = 3").select("client_id", F.lit(None).cast("string").alias("id")))
    opted_in = records.filter("client_id <> 4").select("client_id").distinct()
    return history.deleted(records, gone, opted_in).select("client_id", "id", "pos")


HISTORY_DELETED_SQL = """
WITH e AS (SELECT event_id AS pos, user_id % 7 AS client_id, md5((event_id % 3001)::VARCHAR) AS h FROM events),
v AS (SELECT client_id, 'JQ-' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, pos FROM e)
SELECT client_id, id, pos FROM v WHERE client_id NOT IN (3, 4) AND (client_id, id) NOT IN (SELECT (client_id, id) FROM v WHERE pos % 5 = 0)"""


def run_history(spark, sf_dir):
    rows = history.run_counts(review.match_rows(reviewed(spark, sf_dir)))
    return rows.select("doc_id", F.array_join(F.transform("counts", lambda c: F.concat_ws(":", c["category"], c["replaced"].cast("string"), c["kept"].cast("string"))), ",").alias("counts"))


_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fixed.CATEGORIES) if c in _CATS) + " END"
RUN_HISTORY_SQL = f"WITH {_REVIEW_SQL}, c AS (SELECT doc_id, category, count(*) FILTER (selected) AS a, count(*) FILTER (NOT selected) AS b FROM m GROUP BY ALL) SELECT doc_id, string_agg(category || ':' || a || ':' || b, ',' ORDER BY {_ORDER}) AS counts FROM c GROUP BY doc_id"

# --- assembly ----------------------------------------------------------------------------------------


def text_items(spark, sf_dir):
    """Words of documents as positioned items, one line of text a line, 20 lines a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    w = d.select("doc_id", "line", F.posexplode(F.split("s", " ")).alias("word", "str"))
    return w.select("doc_id", (F.floor(F.col("line") / 20) + 1).cast("int").alias("page"), (F.col("line") % 20 * 100000 + F.col("word")).alias("item_no"), "str", (F.col("word") * 10.0).alias("x"), (F.col("line") * -12.0).alias("y"), F.lit(9.0).alias("width"), F.lit(1.0).alias("height"), F.lit(False).alias("has_eol"))


def page_stats(spark, sf_dir):
    done = assemble.page_stats(assemble.page_texts(text_items(spark, sf_dir)))
    return done.select("doc_id", "page", "n_chars", "is_empty", "is_sparse", "is_faulty")


PAGE_STATS_SQL = r"""
WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'s': x, 'page': (i - 1) // 20 + 1})) AS u FROM documents),
p AS (SELECT doc_id, u.page::INTEGER AS page, string_agg(u.s, '') AS t FROM l GROUP BY ALL)
SELECT doc_id, page, length(regexp_replace(t, '\s', '', 'g')) AS n_chars, n_chars = 0 AS is_empty, n_chars BETWEEN 1 AND 29 AS is_sparse, false AS is_faulty FROM p"""


def _page_counts(items):
    """Documents with an odd id have one page more than their items tell."""
    return items.groupBy("doc_id").agg((F.max("page") + F.max(F.col("doc_id") % 2)).cast("int").alias("n_pages"))


def assemble_pages(spark, sf_dir):
    items = text_items(spark, sf_dir)
    done = assemble.assembled(assemble.page_texts(items), _page_counts(items))
    return done.select("doc_id", F.sha2(F.array_join("warnings", "\n"), 256).alias("warnings_sha256"), "reject_reason", F.sha2("text", 256).alias("text_sha256"))


_PAGES_SQL = r"""
l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'s': trim(regexp_replace(x, ' +', ' ', 'g'), ' '), 'i': i, 'page': (i - 1) // 20 + 1})) AS u FROM documents),
q AS (SELECT doc_id, u.page AS page, string_agg(u.s, chr(10) ORDER BY u.i) FILTER (u.s <> '') AS t FROM l GROUP BY ALL),
r AS (SELECT doc_id, unnest(range(1, max(page) + 1 + doc_id % 2)) AS page FROM q GROUP BY doc_id),
p AS (SELECT doc_id, page, coalesce(t, '') AS t, length(regexp_replace(coalesce(t, ''), '\s', '', 'g')) AS n FROM r LEFT JOIN q USING (doc_id, page))"""
ASSEMBLE_SQL = f"""
WITH {_PAGES_SQL},
d AS (SELECT doc_id, count(*) AS pages, sum(n) AS chars, string_agg('## PDF 第 ' || page || e' 页\\n\\n' || CASE WHEN t = '' THEN '{fixed.EMPTY_PAGE}' ELSE t END, e'\\n\\n' ORDER BY page) AS text,
  count(*) FILTER (n = 0) AS n_empty, string_agg(page::VARCHAR, '、' ORDER BY page) FILTER (n = 0) AS empty, string_agg(page::VARCHAR, '、' ORDER BY page) FILTER (n BETWEEN 1 AND {fixed.SPARSE_CHARS - 1}) AS sparse FROM p GROUP BY doc_id)
SELECT doc_id, sha256('{fixed.PDF_NOTICE}' || e'\\n共 ' || pages || ' 页，其中 ' || (pages - n_empty) || ' 页提取到文字；提取到文字不代表该页内容完整。'
  || coalesce(e'\\n第 ' || empty || ' 页没有提取到文字，已在稿内标记，请勿将缺失内容理解为原文未载明。', '') || coalesce(e'\\n第 ' || sparse || ' 页提取文字很少，可能仅有页码或标题，请检查扫描内容是否遗漏。', '')) AS warnings_sha256,
  CASE WHEN pages > {fixed.PDF_PAGES} THEN 'too many pages' WHEN chars > {fixed.PDF_CHARS} THEN 'too many characters' WHEN chars = 0 THEN 'no text' END AS reject_reason, sha256(text) AS text_sha256 FROM d"""


def scanned_pages(spark, sf_dir):
    """Documents of pages without any text, some of them with a broken character."""
    c = table(spark, sf_dir, "customer")
    items = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit(2).alias("page"), F.lit(0).alias("item_no"), F.when(F.col("c_custkey") % 6 == 0, "a\uFFFD").alias("str"), *[F.lit(0.0).alias(x) for x in ("x", "y", "width", "height")], F.lit(False).alias("has_eol"))
    done = assemble.assembled(assemble.page_texts(items), c.select(F.col("c_custkey").alias("doc_id"), F.lit(3).alias("n_pages")))
    return done.select("doc_id", F.size("warnings").cast("long").alias("n_warnings"), "reject_reason")


SCANNED_SQL = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 6 = 0 THEN 4 ELSE 3 END AS n_warnings, CASE WHEN c_custkey % 6 = 0 THEN 'fault on page 2' ELSE 'no text' END AS reject_reason FROM customer"


def order_tables(spark, sf_dir):
    """Line items of an order as a Markdown table with ragged rows, under a heading."""
    x = table(spark, sf_dir, "lineitem")
    cell = lambda c: F.array(F.concat(F.lit(" "), c, F.lit(" ")), F.lit(" "), F.lit("a|b"))
    row = lambda r: F.when(r["l_linenumber"] % 2 == 1, F.array(cell(r["l_partkey"].cast("string")), cell(r["l_returnflag"]))).otherwise(F.array(cell(r["l_partkey"].cast("string"))))
    # Only what the cells are made from is collected.
    t = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("rs"))
    text = lambda x: F.lit(x).cast("string")
    block = lambda part, no, kind, style, said, rows: F.struct(F.lit(part).alias("part_no"), F.lit(no).alias("block_no"), F.lit(kind).alias("kind"), text(style).alias("style"), text(said).alias("text"), rows.alias("rows"))
    none = F.lit(None).cast("array<array<array<string>>>")
    blocks = F.array(block(0, 0, "p", "Heading2", " Order ", none), block(0, 1, "tbl", None, None, F.transform("rs", row)), block(1, 0, "p", None, "foot", none))
    return assemble.block_documents(t.select(F.col("l_orderkey").alias("doc_id"), F.inline(blocks)))


ORDER_TABLES_SQL = r"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS i, bool_or(l_linenumber % 2 = 1) OVER (PARTITION BY l_orderkey) AS wide,
  '| ' || l_partkey || '；a\|b' || CASE WHEN l_linenumber % 2 = 1 THEN ' | ' || l_returnflag || '；a\|b' WHEN wide THEN ' | ' ELSE '' END || ' |' AS line FROM lineitem)
SELECT l_orderkey AS doc_id, e'## Order\n\n' || max(line) FILTER (i = 1) || chr(10) || CASE WHEN bool_or(wide) THEN '| --- | --- |' ELSE '| --- |' END
  || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (i > 1), '') || e'\n\n---\n\n> 页眉或页脚内容\n\nfoot' AS text FROM r GROUP BY l_orderkey"""


def packages(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    name = F.element_at(F.array(*map(F.lit, ("word/document.xml", "word/header1.xml", "word/media/a.png", "word/comments.xml", "word/footer2.xml", "word/embeddings/b.bin", "docProps/app.xml"))), ((F.col("l_linenumber") - 1) % 7 + 1).cast("int"))
    entries = x.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("entry_no"), name.alias("name"), (F.col("l_quantity") * 45000).cast("long").alias("declared_bytes"))
    done = assemble.package_admission(entries)
    return done.select("doc_id", "reject_reason", F.size("warnings").cast("long").alias("n_warnings"))


PACKAGES_SQL = f"""
WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, (l_linenumber - 1) % 7 AS k, (l_quantity * 45000)::BIGINT AS b, k IN (0, 1, 4) AS needed FROM lineitem),
c AS (SELECT *, needed AND b > least({fixed.PART_BYTES}, {fixed.TOTAL_BYTES} - coalesce(sum(CASE WHEN needed THEN b ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS over FROM e)
SELECT doc_id, CASE WHEN count(DISTINCT k) < count(*) THEN 'duplicate names' WHEN bool_or(over) THEN 'part too large' WHEN NOT bool_or(k = 0) THEN 'no body' END AS reject_reason,
  bool_or(k = 2)::BIGINT + bool_or(k = 3)::BIGINT + bool_or(k = 5)::BIGINT AS n_warnings FROM c GROUP BY doc_id"""


# --- streaming ---------------------------------------------------------------------------------------


def _shared(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{(base or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_redact(spark, sf_dir):
    """Documents replayed as a stream through the whole redaction plan; read back."""
    from ..streaming import jobs

    out = _shared(spark)
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    done = jobs.redact_stream(docs)
    query = done.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.sha2("redacted", 256).alias("redacted_sha256")).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def stream_history(spark, sf_dir):
    """Records replayed as a stream through keyed state; what is in force is read back."""
    from ..streaming import history as stateful

    out = _shared(spark)
    events = table(spark, sf_dir, "events")
    now = events.agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("t")).first()["t"]
    replay = history_rows(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]"))
    stateful.start_history(replay, f"{out}/changes", f"{out}/state", now, availableNow=True).awaitTermination()
    return history_shown(stateful.stored_history(spark, f"{out}/changes"))


def stream_review(spark, sf_dir):
    """Matches and decisions replayed as streams; older, contrary decisions come too and must not hold."""
    from ..streaming import jobs
    from ..streaming import review as stateful

    out = _shared(spark)
    docs = settled(spark, sf_dir)
    docs.write.parquet(f"{out}/docs")
    last = decided(spark.read.parquet(f"{out}/docs")).withColumn("decided_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    older = last.select("doc_id", "match_id", (~F.col("selected")).alias("selected"), F.when(F.col("placeholder").isNotNull(), "older").alias("placeholder"), (F.col("decided_at") - F.expr("INTERVAL 1 DAY")).alias("decided_at"))
    last.unionByName(older).write.parquet(f"{out}/decisions")
    streams = [jobs.read_stream(spark, f"{out}/{x}", spark.read.parquet(f"{out}/{x}").schema) for x in ("docs", "decisions")]
    stateful.start_review(*streams, f"{out}/outcomes", f"{out}/state", availableNow=True).awaitTermination()
    parts = F.split("match_id", "-")
    return stateful.reviewed_matches(spark, f"{out}/outcomes").select("doc_id", F.get(parts, F.lit(1)).cast("int").alias("start"), F.get(parts, F.lit(0)).alias("category"), "selected", "placeholder")


QUERIES = {
    "redact_documents": redact_documents,
    "redact_contracts": redact_contracts,
    "classify_contracts": classify_contracts,
    "detect_email": _rule_hits("D01"),
    "detect_percent": _rule_hits("D22"),
    "detect_permille": _rule_hits("D25"),
    "admission": admission,
    "normalise": normalise,
    "custom_terms": custom_terms,
    "late_term": late_term,
    "quarantine": quarantine,
    "stream_quarantine": stream_quarantine,
    "term_table": term_table,
    "resolve_spans": resolve_spans,
    "review_matches": review_matches,
    "batch_counts": batch_counts,
    "batch_toggle": batch_toggle,
    "risk_retained": risk_retained,
    "report_counts": report_counts,
    "report_texts": report_texts,
    "run_history": run_history,
    "clean_history": clean_history,
    "page_stats": page_stats,
    "assemble_pages": assemble_pages,
    "order_tables": order_tables,
    "packages": packages,
    "stream_redact": stream_redact,
    "stream_history": stream_history,
    "stream_review": stream_review,
    "redact_rules": redact_rules,
    "redact_boundaries": redact_boundaries,
    "redact_roles": redact_roles,
    "keep_amounts": keep_amounts,
    "manual_types": manual_types,
    "select_all": select_all,
    "export_notes": export_notes,
    "history_deleted": history_deleted,
    "scanned_pages": scanned_pages,
}
ORACLE = {
    "redact_contracts": REDACT_CONTRACTS_SQL,
    "classify_contracts": CLASSIFY_SQL,
    "detect_email": _rule_sql("(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}"),
    "detect_percent": _rule_sql("[0-9]+(?:\\.[0-9]+)?\\s*[％%]"),
    "detect_permille": _rule_sql("[0-9]+(?:\\.[0-9]+)?\\s*‰"),
    "admission": ADMISSION_SQL,
    "normalise": NORMALISE_SQL,
    "custom_terms": CUSTOM_TERMS_SQL,
    "late_term": LATE_TERM_SQL,
    "quarantine": _OUTCOMES_SQL,
    "stream_quarantine": _OUTCOMES_SQL,
    "term_table": TERM_TABLE_SQL,
    "resolve_spans": RESOLVE_SQL,
    "review_matches": f"WITH {_REVIEW_SQL} SELECT doc_id, ordinal, st AS start, category, selected, placeholder FROM m",
    "batch_counts": f"WITH {_REVIEW_SQL}, g(batch_group, cats) AS (VALUES {_GROUPS}), k AS (SELECT t.doc_id, g.batch_group, count(m.st) AS total, count(m.st) FILTER (NOT m.selected) AS kept FROM t CROSS JOIN g LEFT JOIN m ON m.doc_id = t.doc_id AND list_contains(g.cats, m.category) GROUP BY ALL) SELECT *, total > 0 AND kept = total AS all_kept FROM k",
    "batch_toggle": f"WITH {_REVIEW_SQL}, z AS (SELECT *, category IN ('date', 'duration') AS tm FROM m), y AS (SELECT *, bool_and(NOT selected) FILTER (tm) OVER (PARTITION BY doc_id) AS ak FROM z) SELECT doc_id, count(*) FILTER (CASE WHEN tm THEN ak ELSE NOT selected END) AS n_kept FROM y GROUP BY doc_id",
    "risk_retained": f"WITH {_REVIEW_SQL} SELECT doc_id, count(*) FILTER (NOT selected AND category IN ({_HIGH})) AS high_risk_kept FROM m GROUP BY doc_id",
    "report_counts": f"WITH {_REVIEW_SQL} SELECT doc_id, {_CASE_LABEL} AS label, count(*) FILTER (selected) AS n_selected, count(*) FILTER (NOT selected) AS n_kept, min(ordinal) AS first_ordinal FROM m GROUP BY ALL",
    "report_texts": REPORT_SQL,
    "run_history": RUN_HISTORY_SQL,
    "clean_history": CLEAN_HISTORY_SQL,
    "page_stats": PAGE_STATS_SQL,
    "assemble_pages": ASSEMBLE_SQL,
    "order_tables": ORDER_TABLES_SQL,
    "packages": PACKAGES_SQL,
    "stream_history": CLEAN_HISTORY_SQL,
    "stream_review": f"WITH {_REVIEW_SQL} SELECT doc_id, st AS start, category, selected, placeholder FROM m",
    "redact_rules": _rendered_sql("技术开发合同", RULE_LINES),
    "redact_boundaries": BOUNDARIES_SQL,
    "redact_roles": _rendered_sql("测试文件", ROLE_LINES),
    "keep_amounts": _rendered_sql("> 甲\n> 乙\n\n测试文件", AMOUNT_LINES),
    "manual_types": MANUAL_SQL,
    "select_all": f"WITH {_REVIEW_SQL} SELECT doc_id, count(*) AS n_selected, count(*) AS n_matches FROM m GROUP BY doc_id",
    "export_notes": f"WITH {_REVIEW_SQL}, k AS (SELECT doc_id, count(*) FILTER (NOT selected AND category IN ({_HIGH})) AS n, count(*) FILTER (selected) AS c FROM m GROUP BY doc_id) SELECT doc_id, '已处理 ' || c || CASE WHEN doc_id % 2 = 0 THEN ' 处候选信息。导出仅包含 PDF 提取文字的脱敏稿，不代表原 PDF 已脱敏或内容完整。' ELSE ' 处候选信息，输出文件只包含脱敏后的文本内容。' END AS summary, CASE WHEN n > 0 THEN '你保留了 ' || n || ' 处高风险信息。仍可导出，但请确认这些内容可以提交给大模型。' ELSE '' END AS note FROM k",
    "history_deleted": HISTORY_DELETED_SQL,
    "scanned_pages": SCANNED_SQL,
}

