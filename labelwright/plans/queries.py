"""Registered queries of the library's own operators, each over whole tables, with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions import text as T
from labelwright.operators import bayes, clean, cluster, distance, evaluate, knn, profile, wordlist
from labelwright.operators.edits import apply_label_edits, edit_stored, read_editable, write_editable
from labelwright.plans import chains, evaluations
from labelwright.plans.views import labelled, messages, passages, raw_messages, table, words
from labelwright.sources.charset import detect_text
from labelwright.sources.files import decode_text, read_labelled, read_raw_csv, read_words, read_words_csv, write_labelled
from labelwright.tables import new_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LABELLED = "labelled AS (SELECT d.doc_id AS row_id, d.text, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 4 ELSE 2 END AS label FROM documents d JOIN labels l USING (doc_id))"
RAW = """raw AS (SELECT doc_id AS row_id, CASE doc_id % 7 WHEN 0 THEN 'RT ' || text WHEN 1 THEN text || ' http://t.co/x' WHEN 2 THEN 'hello @user12 ' || text
  WHEN 3 THEN ':) ' || text || ' :(' WHEN 4 THEN ':( is not :D ' || text ELSE text END AS text FROM documents)"""
P, N = r"(?::\)|:-\)|:D)", r"(?::\(|:-\(|D:)"
RULED = rf"""{RAW}, r AS (SELECT row_id, text, regexp_matches(text, '{P}.*{N}|{N}.*{P}') AS mixed, regexp_matches(text, '( |^)RT( |\z)') AS rt,
  regexp_replace(text, '(http:|https:|www.)[^ ]*( |\z)', '', 'g') AS t1 FROM raw WHERE text IS NOT NULL),
r2 AS (SELECT *, regexp_replace(t1, '( |^)@[^ ]*( |\z)', '', 'g') AS t2 FROM r),
r3 AS (SELECT *, regexp_replace(t2, '[!\?\"\.;,\:\*]', '', 'g') AS t3 FROM r2),
cleaned AS (SELECT row_id, t3 AS text FROM r3 WHERE NOT mixed AND NOT rt)"""
WS = T.WS
SPLIT = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda x: x <> '')"
LOWER = "list_transform({0}, lambda x: lower(x))"
JOINED = "array_to_string(list_sort({0}), ' ')"
WS_SET = f"list_distinct({LOWER.format(SPLIT)})"
ASCII_SET = f"list_distinct({LOWER.format(SPLIT.replace(WS, '[^A-Za-z0-9]+'))})"
ALNUM = LOWER.format(SPLIT.replace(WS, r"[^\p{L}\p{N}]+"))
UNI = f"list_filter({LOWER.format(SPLIT)}, lambda x: length(x) >= 4)"
BI = "CASE WHEN len(u) < 2 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) END"
WORDS = "words AS (SELECT unnest(['in','and','to','is','la','der']) AS word, 1 AS p UNION ALL SELECT unnest(['the','of','a','en','die','que']), 0)"
SPLIT_SQL = f"""{LABELLED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|0'), row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labelled),
split AS (SELECT row_id, text, label, rn <= floor(n * (2::DOUBLE / 3::DOUBLE)) AS is_train FROM ranked)"""
GRID = "grid AS (SELECT * FROM (VALUES (0), (2), (4)) a(real), (VALUES (0), (2), (4)) b(estimated))"
MATRIX = "SELECT g.real, g.estimated, count(p.real) AS n FROM grid g LEFT JOIN pred p ON g.real = p.real AND g.estimated = p.estimated GROUP BY ALL"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _joined(tokens):
    return F.array_join(F.array_sort(tokens), " ")


# --- cleaning ---------------------------------------------------------------------------------------------------------------


@query("rules_clean", f"WITH {RULED} SELECT row_id, text FROM cleaned")
def rules_clean(spark, sf_dir):
    return clean.apply_rules(raw_messages(spark, sf_dir), clean.default_rules())


@query("rules_replace", rf"""WITH {RAW} SELECT row_id, regexp_replace(regexp_replace(replace(text, ':)', '<happy $1 \>'), '(\w+) is not (:D)', '\2 \1 $', 'g'), '( |^)@[^ ]*( |\z)', '', 'g') AS text FROM raw
 WHERE text IS NOT NULL AND NOT regexp_matches(text, '( |^)RT( |\z)')""")
def rules_replace(spark, sf_dir):
    """Rules given in any order are put in order: deletions, replacements (of plain text, and by groups), trims."""
    given = [clean.trim("user", r"( |^)@[^ ]*( |\z)"), clean.replace("smile", r":\)", "<happy $1 \\>", plain=True), clean.replace("laugh", r"(\w+) is not (?<face>:D)", "${face} $1 $$"), clean.delete("retweet", r"( |^)RT( |\z)")]
    return clean.apply_rules(raw_messages(spark, sf_dir), clean.order_rules(given))


@query("rule_audit", f"""WITH {RULED} SELECT row_id, rule_no, rule, action, before, after FROM (
 SELECT row_id, 0 AS rule_no, 'mixed emotions' AS rule, 'delete' AS action, text AS before, CAST(NULL AS VARCHAR) AS after FROM r3 WHERE mixed
 UNION ALL SELECT row_id, 1, 'retweet', 'delete', text, NULL FROM r3 WHERE NOT mixed AND rt
 UNION ALL SELECT row_id, 2, 'url', 'trim', text, t1 FROM r3 WHERE NOT mixed AND NOT rt AND t1 <> text
 UNION ALL SELECT row_id, 3, 'user', 'trim', t1, t2 FROM r3 WHERE NOT mixed AND NOT rt AND t2 <> t1
 UNION ALL SELECT row_id, 4, 'punctuation', 'trim', t2, t3 FROM r3 WHERE NOT mixed AND NOT rt AND t3 <> t2)""")
def rule_audit(spark, sf_dir):
    return clean.rule_audit(raw_messages(spark, sf_dir), clean.default_rules())


@query("rule_counts", f"""WITH {RULED} SELECT 'mixed emotions deletion' AS rule, count(*) FILTER (mixed) AS n FROM r3
 UNION ALL SELECT 'retweet deletion', count(*) FILTER (NOT mixed AND rt) FROM r3 UNION ALL SELECT 'url trim', count(*) FILTER (NOT mixed AND NOT rt AND t1 <> text) FROM r3
 UNION ALL SELECT 'user trim', count(*) FILTER (NOT mixed AND NOT rt AND t2 <> t1) FROM r3 UNION ALL SELECT 'punctuation trim', count(*) FILTER (NOT mixed AND NOT rt AND t3 <> t2) FROM r3""")
def rule_counts(spark, sf_dir):
    return clean.rule_counts(raw_messages(spark, sf_dir), clean.default_rules())


@query("clean", f"WITH {RULED} SELECT min(row_id) AS row_id, 2 AS rating, text FROM cleaned GROUP BY text")
def clean_messages(spark, sf_dir):
    return clean.clean(raw_messages(spark, sf_dir))


@query("clean_pass", f"""WITH {RULED}, k AS (SELECT min(row_id) AS row_id, text FROM cleaned GROUP BY text) SELECT 'row' AS kind, row_id AS a, CAST(2 AS BIGINT) AS b, text AS c FROM k
 UNION ALL SELECT 'duplicates', count(*) - (SELECT count(*) FROM k), NULL, NULL FROM cleaned UNION ALL SELECT 'count', n, NULL, rule FROM ({ORACLE_SQL['rule_counts'].replace(f'WITH {RULED} ', '')})
 UNION ALL SELECT 'audit', row_id, rule_no, rule || ' ' || before || ' > ' || coalesce(after, '') FROM ({ORACLE_SQL['rule_audit'].replace(f'WITH {RULED} ', '')})""")
def clean_with_report(spark, sf_dir):
    """Rows, rule counts, audit and duplicates of one pass."""
    done = clean.clean_pass(raw_messages(spark, sf_dir))
    none = F.lit(None).cast("long")
    parts = [
        done.rows.select(F.lit("row").alias("kind"), F.col("row_id").alias("a"), F.col("rating").cast("long").alias("b"), F.col("text").alias("c")),
        done.duplicates.select(F.lit("duplicates").alias("kind"), F.col("n").alias("a"), none.alias("b"), F.lit(None).cast("string").alias("c")),
        done.counts.select(F.lit("count").alias("kind"), F.col("n").alias("a"), none.alias("b"), F.col("rule").alias("c")),
        done.audit.select(F.lit("audit").alias("kind"), F.col("row_id").alias("a"), F.col("rule_no").cast("long").alias("b"), F.concat("rule", F.lit(" "), "before", F.lit(" > "), F.coalesce("after", F.lit(""))).alias("c")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("dedup_keep_first", "SELECT min(doc_id) AS row_id, text FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    return clean.dedup_keep_first(messages(spark, sf_dir))


@query("dup_count", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY text)")
def dup_count(spark, sf_dir):
    return clean.dup_count(messages(spark, sf_dir))


@query("assign_rating", f"WITH {LABELLED} SELECT row_id, label AS rating FROM labelled UNION ALL SELECT doc_id, 2 FROM documents")
def assign_rating(spark, sf_dir):
    rated = clean.assign_rating(labelled(spark, sf_dir), "label").select("row_id", "rating")
    return rated.unionByName(clean.assign_rating(messages(spark, sf_dir)).select("row_id", "rating"))


@query("apply_label_edits", f"""WITH {LABELLED}, e AS (SELECT conv_id AS row_id, turn AS edit_seq, CAST(turn % 3 * 2 AS INTEGER) AS v FROM conversations),
 x AS (SELECT row_id, arg_max(v, edit_seq) AS v FROM e GROUP BY row_id) SELECT row_id, text, CAST(coalesce(x.v, label) AS INTEGER) AS label FROM labelled LEFT JOIN x USING (row_id)""")
def edits(spark, sf_dir):
    e = table(spark, sf_dir, "conversations").select(F.col("turn").alias("edit_seq"), F.col("conv_id").alias("row_id"), F.lit("label").alias("column"), (F.col("turn") % 3 * 2).cast("string").alias("value"))
    return apply_label_edits(labelled(spark, sf_dir), e)


@query("edit_stored", ORACLE_SQL["apply_label_edits"])
def edits_stored(spark, sf_dir):
    """The same edits into a stored table, in two goes, the second with all edits again."""
    path = new_path(spark, "editable")
    write_editable(labelled(spark, sf_dir), path, part_rows=500)
    e = table(spark, sf_dir, "conversations").select(F.col("turn").alias("edit_seq"), F.col("conv_id").alias("row_id"), F.lit("label").alias("column"), (F.col("turn") % 3 * 2).cast("string").alias("value"))
    edit_stored(spark, path, e.filter("edit_seq < 3"))
    edit_stored(spark, path, e)
    return read_editable(spark, path).select("row_id", "text", "label")


@query("decode_text", r"""SELECT doc_id AS row_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '€ 5 “café” ' || t ELSE 'café ' || t END AS text,
 CASE doc_id % 3 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'windows-1252' ELSE 'ISO-8859-1' END AS encoding FROM (SELECT *, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM documents)""")
def decoded(spark, sf_dir):
    """Every document's bytes, in turn UTF-8, windows-1252 and ISO-8859-1, as a reader of the last sees them."""
    kind, ascii_only = F.col("row_id") % 3, F.regexp_replace("text", r"[^\x00-\x7F]", "")
    misread = F.when(kind == 0, F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).when(kind == 1, F.concat(F.lit("\x80 5 \x93caf\xe9\x94 "), ascii_only)).otherwise(F.concat(F.lit("caf\xe9 "), ascii_only))
    return messages(spark, sf_dir).withColumn("d", decode_text(misread)).select("row_id", "d.text", "d.encoding")


_SAID = {"windows-1250": "Příliš žluťoučký kůň", "windows-1251": "Съешь ещё этих мягких булок", "windows-1253": "Ξεσκεπάζω την βδελυγμία", "shift_jis": "今日はいい天気ですね", "gb18030": "今天天气很好", "ISO-8859-1": "où est la forêt"}


@query("detect_text", "WITH d AS (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t FROM documents) SELECT doc_id AS row_id, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{x} ' || t" for i, x in enumerate(_SAID.values()))
       + " ELSE text END AS text, CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SAID)) + " ELSE 'UTF-8' END AS encoding FROM d WHERE text IS NOT NULL")
def detected(spark, sf_dir):
    """Every document's bytes in turn in one of seven encodings, with a few words that only this encoding makes sense of, as a reader of ISO-8859-1 sees them."""
    kind, ascii_only = F.col("row_id") % 7, F.regexp_replace("text", r"[^\x00-\x7F]", "")
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    for i, (name, said) in enumerate(_SAID.items()):
        misread = F.when(kind == i, F.concat(F.lit(f"{said} ".encode(name).decode("latin-1")), ascii_only)).otherwise(misread)
    rows = messages(spark, sf_dir).filter("text IS NOT NULL")
    return rows.withColumn("d", detect_text(misread)).select("row_id", "d.text", "d.encoding")


# --- files: each query writes a given table into the shared folder and reads it back ------------------------------------------


@query("read_raw_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def raw_csv(spark, sf_dir):
    path = new_path(spark, "raw-csv")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_raw_csv(spark, path).drop("row_id")


_LINE = "regexp_replace(text, '[\\r\\n]+', ' ', 'g')"


def _written(spark, rows):
    path = new_path(spark, "labelled")
    write_labelled(rows.select("rating", F.regexp_replace("text", r"[\r\n]+", " ").alias("message")), path)
    return read_labelled(spark, path, escaped=True).select("label", "text")


@query("read_labelled", f"""WITH {LABELLED} SELECT label, regexp_replace({_LINE}, '^"+|"+$', '', 'g') AS text FROM labelled""")
def labelled_files(spark, sf_dir):
    """Every labelled document as a plain line ``label,text`` of eight files with a header each, every third line with a carriage return at its end."""
    path, end = new_path(spark, "lines"), F.when(F.col("row_id") % 3 == 0, "\r").otherwise("")
    line = F.concat(F.col("label").cast("string"), F.lit(","), F.regexp_replace("text", r"[\r\n]+", " "), end)
    lines = labelled(spark, sf_dir).select(F.pmod("row_id", F.lit(8)).alias("part"), F.lit(1).alias("after"), line.alias("value"))
    heads = spark.range(8).select(F.col("id").alias("part"), F.lit(0).alias("after"), F.lit("label,text").alias("value"))
    lines.unionByName(heads).repartition("part").sortWithinPartitions("part", "after").select("part", "value").write.partitionBy("part").text(path)
    return read_labelled(spark, path).select("label", "text")


@query("write_cleaned", f"WITH {RULED} SELECT 2 AS label, {_LINE} AS text FROM (SELECT text FROM cleaned GROUP BY text)")
def cleaned_files(spark, sf_dir):
    return _written(spark, clean.clean(raw_messages(spark, sf_dir)))


@query("read_words", f"SELECT DISTINCT lower(word) AS word, 'pos' AS polarity FROM (SELECT unnest({SPLIT}) AS word FROM documents)")
def word_file(spark, sf_dir):
    """A word a line, with space around it, from all documents."""
    path = new_path(spark, "words")
    messages(spark, sf_dir).select(F.explode(F.split("text", T.WS)).alias("w")).select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("value")).write.text(path)
    return read_words(spark, path, "pos")


@query("read_words_csv", f"SELECT word, 'neg' AS polarity, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(array_to_string({SPLIT}, ' , '), ',')), '^\\s+|\\s+$', '', 'g') AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_csv_file(spark, sf_dir):
    """A line of words with commas from each document; repeats and case are kept."""
    path = new_path(spark, "words-csv")
    words_ = F.filter(F.split(F.coalesce("text", F.lit("")), T.WS), lambda x: x != "")
    messages(spark, sf_dir).select(F.array_join(words_, " , ").alias("value")).write.text(path)
    return read_words_csv(spark, path, "neg").groupBy("word", "polarity").agg(F.count("*").alias("n"))


# --- profiling --------------------------------------------------------------------------------------------------------------

_CELLS = "c AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([CAST(conv_id AS VARCHAR), CAST(turn % 3 * 2 AS VARCHAR), coalesce(role, ''), coalesce(text, '')]) AS cell FROM conversations)"
_PROFILE = f"WITH {_CELLS}, p AS (SELECT pos, CAST(max(strlen(cell)) AS BIGINT) AS max_len, CAST(floor(sum(strlen(cell)) / count(*)) AS BIGINT) AS avg_len, count(*) AS n_rows, bool_and(regexp_matches(cell, '^(\"[024]\"|[024])$')) AS all_ratings FROM c GROUP BY pos)"


def _sheet(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("a"), (F.col("turn") % 3 * 2).alias("b"), F.col("role").alias("c"), F.col("text").alias("d"))


@query("column_profile", f"{_PROFILE} SELECT * FROM p")
def column_profile(spark, sf_dir):
    return profile.profile_columns(_sheet(spark, sf_dir), None)


@query("match_headers", "SELECT turn % 3 * 2 AS rating, text FROM conversations")
def match_headers(spark, sf_dir):
    """The columns that the header names say, of a sheet that names both."""
    sheet = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), (F.col("turn") % 3 * 2).alias("Polarity"), F.col("role").alias("user"), F.col("text").alias("Tweet"))
    text, rating = profile.match_headers(sheet.columns)
    return sheet.select(F.col(sheet.columns[rating]).alias("rating"), F.col(sheet.columns[text]).alias("text"))


@query("sniff_columns", f"{_PROFILE} SELECT CAST(coalesce((SELECT pos FROM p WHERE max_len <= 280 ORDER BY 280 - avg_len, pos LIMIT 1), 1) AS INTEGER) AS data_column, CAST((SELECT min(pos) FROM p WHERE all_ratings) AS INTEGER) AS rating_column")
def sniff_columns(spark, sf_dir):
    return profile.sniff_columns(_sheet(spark, sf_dir), None)


# --- tokens -----------------------------------------------------------------------------------------------------------------

for _name, _f, _sql in (("tokens_ws", T.tokens_ws, WS_SET), ("tokens_alnum", T.tokens_alnum, ALNUM), ("tokens_ascii", T.tokens_ascii, ASCII_SET), ("tokens_space", T.tokens_space, "list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(x))")):
    query(_name, f"SELECT doc_id AS row_id, {JOINED.format(_sql)} AS tokens FROM documents")(lambda spark, sf_dir, f=_f: messages(spark, sf_dir).select("row_id", _joined(f(F.col("text"))).alias("tokens")))
for _mode, _sql in (("uni", "u"), ("bi", BI), ("unibi", f"list_concat(u, {BI})")):
    query(f"ngrams_{_mode}", f"WITH g AS (SELECT doc_id AS row_id, {UNI} AS u FROM documents) SELECT row_id, {JOINED.format(_sql)} AS tokens FROM g")(lambda spark, sf_dir, m=_mode: messages(spark, sf_dir).select("row_id", _joined(T.ngrams(F.col("text"), m)).alias("tokens")))


@query("representation_presence", f"WITH g AS (SELECT doc_id AS row_id, {UNI} AS u FROM documents) SELECT row_id, {JOINED.format('list_distinct(u)')} AS tokens FROM g")
def representation_presence(spark, sf_dir):
    return messages(spark, sf_dir).select("row_id", _joined(T.representation(T.ngrams(F.col("text"), "uni"), "presence")).alias("tokens"))


@query("label_name", f"WITH {LABELLED} SELECT row_id, CASE label WHEN 4 THEN 'POSITIF' WHEN 2 THEN 'NEUTRE' WHEN 0 THEN 'NÉGATIF' ELSE 'INCONNU' END AS name FROM labelled")
def label_name(spark, sf_dir):
    return labelled(spark, sf_dir).select("row_id", T.label_name(F.col("label")).alias("name"))


# --- word lists -------------------------------------------------------------------------------------------------------------

_COUNTS = f"{LABELLED}, {WORDS}, tok AS (SELECT row_id, unnest({{0}}) AS word FROM {{1}}), c AS (SELECT row_id, count(*) FILTER (p = 1) AS pos, count(*) FILTER (p = 0) AS neg FROM tok JOIN words USING (word) GROUP BY row_id)"
_LABEL = "CASE WHEN pos + neg = 0 THEN 2 WHEN CAST(pos / (pos + neg) AS FLOAT) > CAST({0} AS FLOAT) OR pos = pos + neg THEN 4 WHEN CAST(neg / (pos + neg) AS FLOAT) > CAST({0} AS FLOAT) OR neg = pos + neg THEN 0 ELSE 2 END"
_LISTED = _COUNTS.format(ALNUM, "labelled") + f", l AS (SELECT row_id, label, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM labelled LEFT JOIN c USING (row_id)), est AS (SELECT *, {_LABEL.format(0.5)} AS estimated FROM l)"


@query("polarity_counts", f"WITH {_LISTED} SELECT row_id, pos, neg FROM l")
def polarity_counts(spark, sf_dir):
    return wordlist.polarity_counts(labelled(spark, sf_dir), words(spark)).select("row_id", "pos", "neg")


@query("classify_wordlist", f"WITH {_LISTED} SELECT row_id, pos, neg, estimated FROM est")
def classify_wordlist(spark, sf_dir):
    return wordlist.classify_wordlist(labelled(spark, sf_dir), words(spark)).select("row_id", "pos", "neg", "estimated")


@query("annotate_wordlist", "WITH " + _COUNTS.format("list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(x))", "msg").replace("tok AS", "msg AS (SELECT conv_id * 1000 + turn AS row_id, text FROM conversations), tok AS") + f", l AS (SELECT msg.row_id, text, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM msg LEFT JOIN c USING (row_id)) SELECT {_LABEL.format(0.0)} AS rating, text FROM l")
def annotate_wordlist(spark, sf_dir):
    return _annotated(spark, sf_dir)


def _annotated(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return wordlist.annotate_wordlist(rows, words(spark)).select("rating", "text")


@query("write_annotated", f"SELECT rating AS label, {_LINE} AS text FROM ({ORACLE_SQL['annotate_wordlist']})")
def annotated_files(spark, sf_dir):
    return _written(spark, _annotated(spark, sf_dir))


# --- split and evaluation ---------------------------------------------------------------------------------------------------


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT row_id, label, is_train FROM split")
def stratified_split(spark, sf_dir):
    return evaluate.stratified_split(labelled(spark, sf_dir)).select("row_id", "label", "is_train")


_WORDLIST_PRED = f"WITH {_LISTED}, {SPLIT_SQL[len(LABELLED) + 2:]}, {GRID}, pred AS (SELECT s.label AS real, estimated FROM split s JOIN est USING (row_id) WHERE NOT is_train)"


@query("evaluate_wordlist", f"{_WORDLIST_PRED} {MATRIX}")
def evaluate_wordlist(spark, sf_dir):
    return evaluate.confusion_matrix(evaluations.evaluate_wordlist(labelled(spark, sf_dir), words(spark)))


@query("confusion_totals", f"{_WORDLIST_PRED}, m AS ({MATRIX}) SELECT real, estimated, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY CUBE (real, estimated)")
def confusion_totals(spark, sf_dir):
    return evaluate.confusion_totals(evaluations.evaluate_wordlist(labelled(spark, sf_dir), words(spark)))


# --- Bayes ------------------------------------------------------------------------------------------------------------------


def _bayes_sql(source: str, alpha: float = 1.0, presence: bool = False, mode: str = "unibi") -> str:
    tokens = {"uni": "u", "bi": BI, "unibi": f"list_concat(u, {BI})"}[mode]
    tokens = f"list_distinct({tokens})" if presence else tokens
    return f"""g AS (SELECT row_id, label, {UNI} AS u FROM {source}), tk AS (SELECT row_id, label, unnest({tokens}) AS token FROM g),
priors AS (SELECT label, count(*) AS n, ln(count(*)::DOUBLE / (SELECT count(*) FROM {source})) AS log_prior FROM {source} GROUP BY label),
counts AS (SELECT label, token, count(*) AS n FROM tk GROUP BY ALL),
totals AS (SELECT p.label, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS total, (SELECT count(DISTINCT token) FROM counts) AS vocab_size FROM priors p LEFT JOIN counts c ON p.label = c.label GROUP BY p.label),
defaults AS (SELECT *, ln({alpha}::DOUBLE / (total + {alpha}::DOUBLE * vocab_size)) AS log_default FROM totals),
likelihood AS (SELECT label, token, n, ln((n + {alpha}::DOUBLE) / (total + {alpha}::DOUBLE * vocab_size)) AS log_prob FROM counts JOIN totals USING (label))"""


def _scores_sql(source: str, presence: bool = False, mode: str = "unibi") -> str:
    tokens = {"uni": "u", "bi": BI, "unibi": f"list_concat(u, {BI})"}[mode]
    tokens = f"list_distinct({tokens})" if presence else tokens
    return f"""qg AS (SELECT row_id, {UNI} AS u FROM {source}), qt AS (SELECT row_id, unnest({tokens}) AS token FROM qg),
known AS (SELECT row_id, token, count(*) AS times FROM qt WHERE token IN (SELECT token FROM counts) GROUP BY ALL),
scored AS (SELECT k.row_id, d.label, sum(k.times * coalesce(l.log_prob, d.log_default)) AS s FROM known k JOIN defaults d ON true LEFT JOIN likelihood l ON l.label = d.label AND l.token = k.token GROUP BY ALL),
scores AS (SELECT q.row_id, p.label, p.log_prior + coalesce(s.s, 0) AS score FROM {source} q JOIN priors p ON true LEFT JOIN scored s ON s.row_id = q.row_id AND s.label = p.label),
best AS (SELECT row_id, arg_max(label, struct_pack(a := round(score, 9), b := -label)) AS estimated FROM scores GROUP BY row_id)"""


@query("class_priors", f"WITH {LABELLED}, {_bayes_sql('labelled')} SELECT label, n, round(log_prior, 6) AS log_prior FROM priors")
def class_priors(spark, sf_dir):
    return bayes.class_priors(labelled(spark, sf_dir)).withColumn("log_prior", F.round("log_prior", 6))


@query("token_counts", f"WITH {LABELLED}, {_bayes_sql('labelled')} SELECT * FROM counts")
def token_counts(spark, sf_dir):
    return bayes.token_counts(labelled(spark, sf_dir))


@query("vocabulary", f"WITH {LABELLED}, {_bayes_sql('labelled')} SELECT DISTINCT token FROM counts")
def vocabulary(spark, sf_dir):
    return bayes.vocabulary(bayes.token_counts(labelled(spark, sf_dir)))


@query("class_totals", f"WITH {LABELLED}, {_bayes_sql('labelled', 0.5, True)} SELECT label, total, vocab_size, round(log_default, 6) AS log_default FROM defaults")
def class_totals(spark, sf_dir):
    return bayes.train_bayes(labelled(spark, sf_dir), "lidstone", "presence").totals.withColumn("log_default", F.round("log_default", 6))


@query("likelihoods", f"WITH {LABELLED}, {_bayes_sql('labelled')} SELECT label, token, n, round(log_prob, 6) AS log_prob FROM likelihood")
def likelihoods(spark, sf_dir):
    return bayes.train_bayes(labelled(spark, sf_dir)).likelihood.withColumn("log_prob", F.round("log_prob", 6))


@query("likelihoods_in_batches", ORACLE_SQL["likelihoods"])
def likelihoods_in_batches(spark, sf_dir):
    """Counts of three batches, each kept by itself, make the model of all messages."""
    path, rows = new_path(spark, "bayes-counts"), labelled(spark, sf_dir)
    for k in range(3):
        bayes.count_bayes(rows.filter(F.col("row_id") % 3 == k)).append(path, str(k))
    model = bayes.bayes_model(bayes.BayesCounts.load(spark, path))
    return model.likelihood.withColumn("log_prob", F.round("log_prob", 6))


_TRAIN = f"{SPLIT_SQL}, train AS (SELECT * FROM split WHERE is_train), test AS (SELECT * FROM split WHERE NOT is_train)"


@query("bayes_scores", f"WITH {_TRAIN}, {_bayes_sql('train')}, {_scores_sql('test')} SELECT row_id, label, round(score, 5) AS score FROM scores")
def bayes_scores(spark, sf_dir):
    train, test = evaluations.split(labelled(spark, sf_dir))
    return bayes.bayes_scores(test, bayes.train_bayes(train)).withColumn("score", F.round("score", 5))


@query("classify_bayes", f"WITH {_TRAIN}, {_bayes_sql('train')}, {_scores_sql('test')} SELECT row_id, estimated FROM best")
def classify_bayes(spark, sf_dir):
    train, test = evaluations.split(labelled(spark, sf_dir))
    return bayes.classify_bayes(test, bayes.train_bayes(train)).select("row_id", "estimated")


def _bayes_matrix(alpha, presence, mode):
    return f"WITH {_TRAIN}, {_bayes_sql('train', alpha, presence, mode)}, {_scores_sql('test', presence, mode)}, {GRID}, pred AS (SELECT label AS real, estimated FROM test JOIN best USING (row_id)) {MATRIX}"


for _name, _alpha, _presence, _mode in (("evaluate_bayes", 1.0, False, "unibi"), ("evaluate_bayes_presence_uni", 1.0, True, "uni"), ("evaluate_bayes_lidstone_bi", 0.5, False, "bi")):
    query(_name, _bayes_matrix(_alpha, _presence, _mode))(lambda spark, sf_dir, a=_alpha, p=_presence, m=_mode: evaluate.confusion_matrix(evaluations.evaluate_bayes(labelled(spark, sf_dir), a, "presence" if p else "frequency", m)))


# --- distances and neighbours -----------------------------------------------------------------------------------------------


def _near_sql(queries: str, base: str, tokens: str, both_empty: float) -> str:
    return f"""qs AS (SELECT row_id AS query_id, {tokens} AS t FROM {queries}), bs AS (SELECT row_id AS base_id, label, {tokens} AS t FROM {base}),
dist AS (SELECT query_id, base_id, label, len(list_intersect(qs.t, bs.t)) AS c, len(qs.t) AS a, len(bs.t) AS b FROM qs, bs),
ranked_n AS (SELECT query_id, base_id, label, CASE WHEN a + b - c = 0 THEN {both_empty}::DOUBLE ELSE (a + b - 2 * c)::DOUBLE / (a + b - c) END AS distance FROM dist),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS INTEGER) AS rank FROM ranked_n)"""


_PASSAGES = "passages AS (SELECT item_id AS row_id, text, CAST(item_id % 3 * 2 AS INTEGER) AS label FROM benchmark)"


@query("knn_neighbours", f"WITH {LABELLED}, {_PASSAGES}, {_near_sql('passages', 'labelled', WS_SET, 0.0)} SELECT query_id, rank, round(distance, 9) AS distance, base_id, label FROM near WHERE rank <= 5")
def knn_neighbours(spark, sf_dir):
    return knn.knn_neighbours(passages(spark, sf_dir), labelled(spark, sf_dir), 5).withColumn("distance", F.round("distance", 9))


_MESSAGES = "messages AS (SELECT conv_id * 1000 + turn AS row_id, text, CAST(turn % 3 * 2 AS INTEGER) AS label FROM conversations), asked AS (SELECT * FROM messages WHERE row_id % 5 = 0)"


@query("knn_messages", f"WITH {_MESSAGES}, {_near_sql('asked', 'messages', WS_SET, 0.0)} SELECT query_id, rank, round(distance, 9) AS distance, base_id, label FROM near WHERE rank <= 3")
def knn_messages(spark, sf_dir):
    """Short texts: neighbours of each fifth chat message among all."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", (F.col("turn") % 3 * 2).cast("int").alias("label"))
    return knn.knn_neighbours(rows.filter("row_id % 5 = 0"), rows, 3).withColumn("distance", F.round("distance", 9))


@query("label_by_seed", "WITH " + _COUNTS.format(ALNUM, "msg").replace("tok AS", "msg AS (SELECT conv_id * 1000 + turn AS row_id, text FROM conversations), tok AS") + f""", seeded AS (
 SELECT msg.row_id, text, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM msg LEFT JOIN c USING (row_id)), known AS (SELECT row_id, text, {_LABEL.format(0.5)} AS label FROM seeded WHERE pos + neg >= 3),
 asked AS (SELECT row_id, text FROM seeded WHERE pos + neg < 3), {_near_sql('asked', 'known', WS_SET, 0.0)}, nn AS (SELECT * FROM near WHERE rank <= 5), v AS (SELECT query_id, label, count(*)::DOUBLE AS w, min(rank) AS r FROM nn GROUP BY ALL),
 best AS (SELECT query_id AS row_id, arg_max(label, struct_pack(a := w, b := -r, c := -label)) AS estimated FROM v GROUP BY query_id)
 SELECT row_id, label AS estimated, 'words' AS by FROM known UNION ALL SELECT row_id, estimated, 'knn' FROM asked LEFT JOIN best USING (row_id)""")
def seeded(spark, sf_dir):
    """Chat messages with three words of the lists are the base by which the others are labelled."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text")
    return chains.label_by_seed(rows, words(spark), "knn", least=3).select("row_id", "estimated", "by")


@query("nearest_neighbour", f"WITH {LABELLED}, {_PASSAGES}, {_near_sql('passages', 'labelled', ASCII_SET, 1.0)} SELECT query_id, base_id, round(distance, 9) AS distance FROM near WHERE rank <= 1")
def nearest_neighbour(spark, sf_dir):
    return cluster.nearest_neighbour(passages(spark, sf_dir), labelled(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


_KNN = f"WITH {_TRAIN}, {_near_sql('test', 'train', WS_SET, 0.0)}, nn AS (SELECT * FROM near WHERE rank <= 5)"
_MAJORITY = "v AS (SELECT query_id, label, count(*)::DOUBLE AS w, min(rank) AS r FROM nn GROUP BY ALL)"
_WEIGHTED = "v AS (SELECT query_id, label, round(sum(1 / (distance + 1e-5)), 9) AS w, min(rank) AS r FROM nn GROUP BY ALL)"
_VOTED = "best AS (SELECT query_id AS row_id, arg_max(label, struct_pack(a := w, b := -r, c := -label)) AS estimated FROM v GROUP BY query_id)"

for _kind, _votes in (("majority", _MAJORITY), ("weighted", _WEIGHTED)):
    query(f"vote_{_kind}", f"{_KNN}, {_votes}, {_VOTED} SELECT row_id, estimated FROM best")(lambda spark, sf_dir, k=_kind: (lambda s: knn.classify_knn(s[1], s[0], 5, k).select("row_id", "estimated"))(evaluations.split(labelled(spark, sf_dir))))
    query(f"evaluate_knn_{_kind}", f"{_KNN}, {_votes}, {_VOTED}, {GRID}, pred AS (SELECT label AS real, estimated FROM test JOIN best USING (row_id)) {MATRIX}")(lambda spark, sf_dir, k=_kind: evaluate.confusion_matrix(evaluations.evaluate_knn(labelled(spark, sf_dir), 5, k)))


_ACCURACY = "round(avg(CASE WHEN label = estimated THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n"
_GRID = [f"SELECT 'words' AS setting, {_ACCURACY} FROM (WITH {_LISTED} SELECT row_id, estimated FROM est) JOIN (WITH {_TRAIN} SELECT row_id, label FROM test) USING (row_id)"]
_GRID += [
    f"SELECT 'knn {k} {kind}' AS setting, {_ACCURACY} FROM (WITH {_TRAIN}, {_near_sql('test', 'train', WS_SET, 0.0)}, nn AS (SELECT * FROM near WHERE rank <= {k}), {votes}, {_VOTED} SELECT label, estimated FROM test JOIN best USING (row_id))"
    for k in (3, 5, 10) for kind, votes in (("majority", _MAJORITY), ("weighted", _WEIGHTED))
]
_GRID += [
    f"SELECT 'bayes {kind} {name}' AS setting, {_ACCURACY} FROM (WITH {_TRAIN}, {_bayes_sql('train', alpha, kind == 'presence')}, {_scores_sql('test', kind == 'presence')} SELECT label, estimated FROM test JOIN best USING (row_id))"
    for kind in ("frequency", "presence") for name, alpha in bayes.SMOOTHING.items()
]


@query("compare_settings", " UNION ALL ".join(_GRID))
def compare_settings(spark, sf_dir):
    made = evaluations.grid(labelled(spark, sf_dir), words(spark))
    return evaluate.compare_settings(made).withColumn("accuracy", F.round("accuracy", 6))


@query("pairwise_distances", f"WITH {_PASSAGES}, s AS (SELECT row_id, {ASCII_SET} AS t FROM passages), d AS (SELECT a.row_id AS i, b.row_id AS j, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS x, len(b.t) AS y FROM s a, s b WHERE a.row_id < b.row_id) SELECT i, j, round(CASE WHEN x + y - c = 0 THEN 1::DOUBLE ELSE (x + y - 2 * c)::DOUBLE / (x + y - c) END, 9) AS distance FROM d")
def pairwise_distances(spark, sf_dir):
    return distance.pairwise_distances(passages(spark, sf_dir), "ascii", dense=True).withColumn("distance", F.round("distance", 9))


# --- clustering ---------------------------------------------------------------------------------------------------------------

_DISSIMILAR = {
    "average": "1 - alike / (size_a * size_b)",
    "complete": "CASE WHEN n = size_a * size_b THEN far ELSE 1::DOUBLE END",
    "ward": "sqrt(greatest(0::DOUBLE, 2 * (size_a * size_b)::DOUBLE / (size_a + size_b) * ((squares + (size_a * size_b - n)) / (size_a * size_b) - (within_a / (size_a * size_a) + within_b / (size_b * size_b)) / 2)))",
}


def _tree_sql(source: str, method: str = "average") -> str:
    """CTEs up to ``tree`` (step, cluster1, cluster2, new_cluster, dissimilarity, size, keep1, keep2) of a relation's texts.

    A turn of the recursion merges all pairs of clusters that are each other's nearest.
    """
    dense = "" if method == "ward" else "WHERE distance < 1"
    return f"""leaves AS (SELECT row_id AS id, {ASCII_SET} AS t, row_number() OVER (ORDER BY row_id) - 1 AS leaf FROM {source}),
far_pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) AS c, len(a.t) AS x, len(b.t) AS y FROM leaves a, leaves b WHERE a.id < b.id),
pairs AS (SELECT a, b, CASE WHEN x + y - c = 0 THEN 1::DOUBLE ELSE (x + y - 2 * c)::DOUBLE / (x + y - c) END AS distance FROM far_pairs),
turns AS (SELECT 0 AS turn, a, b, 1::BIGINT AS n, 1 - distance AS alike, distance * distance AS squares, distance AS far, 1::BIGINT AS size_a, 1::BIGINT AS size_b, 0::DOUBLE AS within_a, 0::DOUBLE AS within_b, false AS merged, 0::DOUBLE AS d FROM pairs {dense}
 UNION ALL (WITH own AS (SELECT * EXCLUDE (d, merged), {_DISSIMILAR[method]} AS d FROM turns WHERE NOT merged),
  sorted AS (SELECT *, struct_pack(d := round(d, 12), h := md5(a || '|' || b), a := a, b := b) AS ord FROM own),
  ends AS (SELECT id, min(ord) AS best FROM (SELECT a AS id, ord FROM sorted UNION ALL SELECT b, ord FROM sorted) GROUP BY id),
  merges AS (SELECT s.*, size_a + size_b AS size, within_a + within_b + 2 * (squares + size_a * size_b - n) AS within FROM sorted s JOIN (SELECT best FROM ends GROUP BY best HAVING count(*) = 2) m ON s.ord = m.best),
  moves AS (SELECT a AS id, a AS keep, size, within FROM merges UNION ALL SELECT b, a, size, within FROM merges),
  moved AS (SELECT own.*, coalesce(p.keep, a) AS to_a, coalesce(q.keep, b) AS to_b, coalesce(p.size, size_a) AS s_a, coalesce(q.size, size_b) AS s_b, coalesce(p.within, within_a) AS w_a, coalesce(q.within, within_b) AS w_b FROM own LEFT JOIN moves p ON p.id = a LEFT JOIN moves q ON q.id = b)
  SELECT any_value(turn) + 1, least(to_a, to_b), greatest(to_a, to_b), CAST(sum(n) AS BIGINT), sum(alike), sum(squares), max(far), max(CASE WHEN to_a < to_b THEN s_a ELSE s_b END), max(CASE WHEN to_a < to_b THEN s_b ELSE s_a END),
    max(CASE WHEN to_a < to_b THEN w_a ELSE w_b END), max(CASE WHEN to_a < to_b THEN w_b ELSE w_a END), false, 0::DOUBLE FROM moved WHERE to_a <> to_b GROUP BY least(to_a, to_b), greatest(to_a, to_b)
  UNION ALL SELECT turn + 1, a, b, n, alike, squares, far, size_a, size_b, within_a, within_b, true, d FROM merges)),
near_merges AS (SELECT turn, a AS keep1, b AS keep2, d AS dissimilarity, size_a + size_b AS size FROM turns WHERE merged),
apart AS (SELECT id, coalesce((SELECT max(size) FROM near_merges m WHERE m.keep1 = id), 1) AS size FROM leaves WHERE id NOT IN (SELECT keep2 FROM near_merges)),
last_merges AS (SELECT 1000000 AS turn, min(id) OVER () AS keep1, id AS keep2, 1::DOUBLE AS dissimilarity, CAST(sum(size) OVER (ORDER BY id) AS BIGINT) AS size, row_number() OVER (ORDER BY id) AS r FROM apart),
steps AS (SELECT *, row_number() OVER (ORDER BY round(dissimilarity, 9), turn, keep1, size, keep2) - 1 AS step FROM (SELECT * FROM near_merges UNION ALL SELECT * EXCLUDE (r) FROM last_merges WHERE r > 1)),
names AS (SELECT s.step, x.id, coalesce((SELECT count(*) FROM leaves) + (SELECT max(e.step) FROM steps e WHERE e.keep1 = x.id AND e.step < s.step), x.leaf) AS name FROM steps s JOIN leaves x ON x.id = s.keep1 OR x.id = s.keep2),
tree AS (SELECT CAST(s.step AS INTEGER) AS step, least(p.name, q.name) AS cluster1, greatest(p.name, q.name) AS cluster2, (SELECT count(*) FROM leaves) + s.step AS new_cluster, dissimilarity, size, keep1, keep2
 FROM steps s JOIN names p ON p.step = s.step AND p.id = keep1 JOIN names q ON q.step = s.step AND q.id = keep2)"""


def _cut_sql(source: str, k: int) -> str:
    """CTE ``membership`` (row_id, cluster): the first merges of ``tree`` done, so that k clusters are left."""
    return f"""tops AS (SELECT row_id, row_id AS top FROM {source} UNION ALL SELECT tops.row_id, keep1 FROM tops JOIN tree ON keep2 = top WHERE step < (SELECT count(*) FROM {source}) - {k}),
membership AS (SELECT row_id, min(top) AS cluster FROM tops GROUP BY row_id)"""


def _clustered_sql(queries: str, base: str, fitted: str, k: int) -> str:
    """CTE ``best`` (row_id, estimated): the label of the cluster of each row's nearest fitted row; all of the base votes."""
    return f"""{_cut_sql(fitted, k)}, {_near_sql(base, fitted, ASCII_SET, 1.0).replace('near AS', 'base_near AS').replace('dist AS', 'base_dist AS').replace('FROM dist', 'FROM base_dist').replace('ranked_n', 'base_ranked').replace('qs AS', 'base_q AS').replace('bs AS', 'base_b AS').replace('FROM qs, bs', 'FROM base_q, base_b').replace('qs.t', 'base_q.t').replace('bs.t', 'base_b.t')},
voters AS (SELECT * FROM membership UNION ALL SELECT query_id, cluster FROM base_near JOIN membership ON row_id = base_id WHERE rank = 1 AND query_id NOT IN (SELECT row_id FROM membership)),
votes AS (SELECT cluster, label, count(*) AS n FROM voters JOIN {base} USING (row_id) GROUP BY ALL), named AS (SELECT cluster, arg_max(label, struct_pack(a := n, b := -label)) AS label FROM votes GROUP BY cluster),
{_near_sql(queries, fitted, ASCII_SET, 1.0)}, best AS (SELECT query_id AS row_id, named.label AS estimated FROM near JOIN membership ON row_id = base_id JOIN named USING (cluster) WHERE rank = 1)"""


for _method in cluster.METHODS:
    query(f"linkage_{_method}", f"WITH RECURSIVE {_PASSAGES}, {_tree_sql('passages', _method)} SELECT step, cluster1, cluster2, new_cluster, round(dissimilarity, 9) AS dissimilarity, size FROM tree")(
        lambda spark, sf_dir, m=_method: cluster.linkage(passages(spark, sf_dir), m).select("step", "cluster1", "cluster2", "new_cluster", F.round("dissimilarity", 9).alias("dissimilarity"), "size"))


for _method in ("average", "complete"):
    query(f"linkage_labelled_{_method}", f"WITH RECURSIVE {LABELLED}, {_tree_sql('labelled', _method)} SELECT step, cluster1, cluster2, new_cluster, round(dissimilarity, 9) AS dissimilarity, size FROM tree")(
        lambda spark, sf_dir, m=_method: cluster.linkage(labelled(spark, sf_dir), m).select("step", "cluster1", "cluster2", "new_cluster", F.round("dissimilarity", 9).alias("dissimilarity"), "size"))


@query("cut", f"WITH RECURSIVE {_PASSAGES}, {_tree_sql('passages')}, {_cut_sql('passages', 3)} SELECT row_id, cluster FROM membership")
def cut(spark, sf_dir):
    rows = passages(spark, sf_dir)
    return cluster.cut(cluster.linkage(rows), rows, 3)


def _by_language(spark, sf_dir):
    first = F.min("doc_id").alias("cluster")
    docs = table(spark, sf_dir, "documents")
    names = docs.groupBy("lang").agg(first)
    return docs.join(names, docs.lang.eqNullSafe(names.lang)).select(F.col("doc_id").alias("row_id"), "cluster")


_MEMBERS = "members AS (SELECT doc_id AS row_id, min(doc_id) OVER (PARTITION BY lang) AS cluster FROM documents), votes AS (SELECT cluster, label, count(*) AS n FROM labelled JOIN members USING (row_id) GROUP BY ALL)"


@query("cluster_votes", f"WITH {LABELLED}, {_MEMBERS} SELECT * FROM votes")
def cluster_votes(spark, sf_dir):
    return cluster.cluster_votes(labelled(spark, sf_dir), _by_language(spark, sf_dir))


@query("cluster_labels", f"WITH {LABELLED}, {_MEMBERS} SELECT m.cluster, coalesce(arg_max(v.label, struct_pack(a := v.n, b := -v.label)), 2) AS label FROM (SELECT DISTINCT cluster FROM members) m LEFT JOIN votes v USING (cluster) GROUP BY m.cluster")
def cluster_labels(spark, sf_dir):
    return cluster.cluster_labels(labelled(spark, sf_dir), _by_language(spark, sf_dir))


@query("classify_cluster", f"WITH RECURSIVE {LABELLED}, {_PASSAGES}, {_tree_sql('passages')}, {_clustered_sql('labelled', 'passages', 'passages', 3)} SELECT row_id, estimated FROM best")
def classify_cluster(spark, sf_dir):
    base = stored(passages(spark, sf_dir), "base")
    return cluster.classify_cluster(labelled(spark, sf_dir), base, 3).select("row_id", "estimated")


_FITTED = f"fitted AS (SELECT * FROM train ORDER BY md5(row_id || '|fit'), row_id LIMIT {cluster.FIT_ROWS})"


@query("evaluate_cluster", f"WITH RECURSIVE {_TRAIN}, {_tree_sql('train')}, {_clustered_sql('test', 'train', 'train', 3)}, {GRID}, pred AS (SELECT label AS real, estimated FROM test JOIN best USING (row_id)) {MATRIX}")
def evaluate_cluster(spark, sf_dir):
    return evaluate.confusion_matrix(evaluations.evaluate_cluster(labelled(spark, sf_dir), 3))


def _cluster_setting(method: str, k: int) -> str:
    return f"SELECT 'cluster {method} {k}' AS setting, {_ACCURACY} FROM (WITH RECURSIVE {_TRAIN}, {_FITTED}, {_tree_sql('fitted', method)}, {_clustered_sql('test', 'train', 'fitted', k)} SELECT label, estimated FROM test JOIN best USING (row_id))"


@query("compare_clusters", " UNION ALL ".join(_cluster_setting(m, k) for m in cluster.METHODS for k in (2, 3)))
def compare_clusters(spark, sf_dir):
    return evaluate.compare_settings(evaluations.cluster_grid(labelled(spark, sf_dir))).withColumn("accuracy", F.round("accuracy", 6))
