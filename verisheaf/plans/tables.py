"""Frames that the registered queries share, and the same frames as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisheaf.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Phrases of generated reports; a report takes one of each by its number.
VIEWS = (
    "左上图：肝穿组织共见7个中小汇管区，小叶结构可辨", "左上图：汇管区轻度炎症，可见点状坏死3个", "左上图：肝细胞气球样变约30%，大泡性脂变", "左上图： 小叶内炎症，未见桥接坏死",
    "左上图：", "汇管区扩大，纤维组织增生明显",
)
OTHERS = (
    "右上图：汇管区中度炎性细胞浸润，可见淋巴细胞聚集灶", "右上图：未见明显界面炎，未见细胞管反应", "右上图：可见界面性肝炎，不能排除胆管损伤", "左上图：重复的汇管区描述，浆细胞浸润",
    "右上图（）  脂变约 20%，考虑胆汁淤积；少量铁沉积", "<think>内容</think>右上图：上皮样肉芽肿",
)
ENDS = (
    "病理诊断：原发性胆汁性胆管炎 I期", "病理诊断： 考虑AIH并PBC（G2S3期）", "病理诊断:慢性乙型肝炎，S2期。建议随访", "病理诊断：未找到", "病理诊断：", "描述到此为止",
    "病理诊断：NASH伴肝纤维化；Ⅲ期",
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, case_id, reference, prediction: two generated reports per order, of up to three phrases each."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))
    k = F.col("o_orderkey")
    join = lambda a, b, c: F.concat_ws("\n", pick(VIEWS, a), pick(OTHERS, b), pick(ENDS, c))
    # Orders are narrow and texts are dear, so rows are dealt first: one file's row group would keep one task busy.
    dealt = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "o_orderkey")
    return dealt.select(
        k.alias("report_id"), F.col("o_custkey").alias("case_id"), join(k, k + F.col("o_custkey"), k).alias("reference"), join(k, k * 3 + 1, k + F.pmod(F.col("o_custkey"), F.lit(3))).alias("prediction")
    )


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _pick(words, n: str) -> str:
    return f"({_list(words)})[CAST(({n}) % {len(words)} AS INTEGER) + 1]"


REPORTS = f"""reports AS (
  SELECT o_orderkey AS report_id, o_custkey AS case_id,
         concat_ws(chr(10), {_pick(VIEWS, 'o_orderkey')}, {_pick(OTHERS, 'o_orderkey + o_custkey')}, {_pick(ENDS, 'o_orderkey')}) AS reference,
         concat_ws(chr(10), {_pick(VIEWS, 'o_orderkey')}, {_pick(OTHERS, 'o_orderkey * 3 + 1')}, {_pick(ENDS, 'o_orderkey + o_custkey % 3')}) AS prediction
  FROM orders
)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, turn, reference (the turn before) and prediction (an assistant's turn) of conversations."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("reference", before).where((F.col("role") == "assistant") & F.col("reference").isNotNull())
    return turns.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), "turn", "reference", F.col("text").alias("prediction"))


PAIRS = """pairs AS (
  SELECT conv_id || '-' || turn AS pair_id, turn, reference, text AS prediction
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations)
  WHERE role = 'assistant' AND reference IS NOT NULL
)"""


def tokenized(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", "turn", T.tokens(F.col("reference")).alias("ref_tokens"), T.tokens(F.col("prediction")).alias("pred_tokens"))


# --- the same scalars in SQL -------------------------------------------------------------------------------------

WS = r"[\s\x{00a0}\x{3000}]"


def sql_normalize(x: str) -> str:
    out = rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '(?is)<think>.*?</think>', '', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+\z', '', 'g')"


def sql_normalize_space(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+\z', '', 'g')"


def sql_compact(x: str) -> str:
    return f"lower(regexp_replace({sql_normalize(x)}, '{WS}+', '', 'g'))"


def sql_squeezed(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g'))"


TOKEN = r"[\x{4e00}-\x{9fff}]|[A-Za-z]+|\d+(?:\.\d+)?|[^\s]"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_normalize(x)}, '{TOKEN}')"


def sql_extract_diagnosis(x: str) -> str:
    line = rf"regexp_extract({sql_normalize(x)}, '病理诊断{WS}*[：:]{WS}*([^\n]*)', 1)"
    strip = lambda v: rf"regexp_replace({v}, '^{WS}+|{WS}+\z', '', 'g')"
    return strip(rf"regexp_replace({strip(line)}, '[。；;].*$', '')")


def sql_canonical(x: str) -> str:
    from verisheaf.functions import lexicon as L

    out = f"lower(CASE WHEN contains(coalesce({x}, ''), '病理诊断') THEN {sql_extract_diagnosis(x)} ELSE {sql_normalize(x)} END)"
    out = f"regexp_replace({out}, '(?i)[（(][^）)]*(?:期|级|ama|评分)[^）)]*[）)]', '', 'g')"
    out = f"regexp_replace({out}, '(?i)(?:分期|stage)?{WS}*[ivxⅠⅡⅢⅣ一二三四0-4]+{WS}*期', '', 'g')"
    out = f"regexp_replace({out}, '^(?:考虑|倾向|符合|诊断为|提示){WS}*', '')"
    for a, b in L.SYNONYMS.items():
        out = f"replace({out}, '{a.lower()}', '{b}')"
    return f"coalesce(nullif(regexp_replace({out}, '[\\s\\x{{00a0}}\\x{{3000}}，,。；;：:、]+', '', 'g'), ''), '__MISSING__')"


def prf_sql(overlap: str, predicted: str, reference: str) -> str:
    """precision, recall, f1 columns."""
    p = f"(CASE WHEN {predicted} > 0 THEN {overlap}::DOUBLE / {predicted} WHEN {reference} = 0 THEN 1.0 ELSE 0.0 END)"
    r = f"(CASE WHEN {reference} > 0 THEN {overlap}::DOUBLE / {reference} WHEN {predicted} = 0 THEN 1.0 ELSE 0.0 END)"
    return f"round({p}::DOUBLE, 9) AS precision, round({r}::DOUBLE, 9) AS recall, round((CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END)::DOUBLE, 9) AS f1"
