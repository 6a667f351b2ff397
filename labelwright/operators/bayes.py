"""Multinomial naive Bayes on n-grams.

What is learnt is two tables of counts: messages a label, tokens a label. Counts of more messages are added to them; priors, totals,
likelihoods and any smoothing follow from the counts alone. Scoring is one join on token and one grouping by message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.functions.text import ngrams, representation
from labelwright.tables import stored

#: Additive smoothing by name.
SMOOTHING = {"laplace": 1.0, "lidstone": 0.5}


@dataclass
class BayesModel:
    """priors(label, n, log_prior), totals(label, total, vocab_size, log_default), likelihood(label, token, n, log_prob)."""

    priors: DataFrame
    totals: DataFrame
    likelihood: DataFrame
    repr: str = "frequency"
    ngram: str = "unibi"

    def save(self, path: str) -> None:
        for name in ("priors", "totals", "likelihood"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str, repr: str = "frequency", ngram: str = "unibi") -> BayesModel:
        return BayesModel(*[spark.read.parquet(f"{path}/{n}") for n in ("priors", "totals", "likelihood")], repr, ngram)


@dataclass
class BayesCounts:
    """messages(label, n) and tokens(label, token, n): what models are made of. Counts of one representation and n-gram mode add up."""

    messages: DataFrame
    tokens: DataFrame
    repr: str = "frequency"
    ngram: str = "unibi"

    def __add__(self, other: BayesCounts) -> BayesCounts:
        if (self.repr, self.ngram) != (other.repr, other.ngram):
            raise ValueError(f"counts of {self.repr} {self.ngram} and of {other.repr} {other.ngram} don't add up")
        sums = F.sum("n").alias("n")
        messages = self.messages.unionByName(other.messages).groupBy("label").agg(sums)
        return BayesCounts(messages, self.tokens.unionByName(other.tokens).groupBy("label", "token").agg(sums), self.repr, self.ngram)

    def append(self, path: str, batch: str) -> None:
        """Keep these counts under ``path`` as batch ``batch``; a batch of that name is replaced, so one that is run again counts once."""
        for name in ("messages", "tokens"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{self.repr}-{self.ngram}/{name}/batch={batch}")

    @staticmethod
    def load(spark: SparkSession, path: str, repr: str = "frequency", ngram: str = "unibi") -> BayesCounts:
        """The sum of all batches kept under ``path``; texts aren't read again."""
        sums = F.sum("n").alias("n")
        messages, tokens = (spark.read.parquet(f"{path}/{repr}-{ngram}/{name}") for name in ("messages", "tokens"))
        return BayesCounts(messages.groupBy("label").agg(sums), tokens.groupBy("label", "token").agg(sums), repr, ngram)


def class_priors(df: DataFrame, label_col: str = "label") -> DataFrame:
    return _priors(df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")))


def _priors(messages: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())  # over one row a label
    return messages.select("label", "n", F.log(F.col("n") / total).alias("log_prior"))


def token_counts(df: DataFrame, repr: str = "frequency", ngram: str = "unibi", text_col: str = "text", label_col: str = "label") -> DataFrame:
    tokens = representation(ngrams(F.col(text_col), ngram), repr)
    return df.select(F.col(label_col).alias("label"), F.explode(tokens).alias("token")).groupBy("label", "token").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    return counts.select("token").distinct()


def class_totals(priors: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """label, total, vocab_size, log_default; a label without tokens has total 0."""
    sums = counts.groupBy("label").agg(F.sum("n").alias("total"))
    size = vocabulary(counts).agg(F.count("*").alias("vocab_size")).withColumn("_one", F.lit(1))
    totals = priors.select("label").join(sums, "label", "left").select("label", F.coalesce("total", F.lit(0)).alias("total"), F.lit(1).alias("_one")).join(F.broadcast(size), "_one").drop("_one")
    return totals.withColumn("log_default", F.log(F.lit(alpha) / (F.col("total") + F.lit(alpha) * F.col("vocab_size"))))


def likelihoods(counts: DataFrame, totals: DataFrame, alpha: float = 1.0) -> DataFrame:
    return counts.join(F.broadcast(totals), "label").select("label", "token", "n", F.log((F.col("n") + F.lit(alpha)) / (F.col("total") + F.lit(alpha) * F.col("vocab_size"))).alias("log_prob"))


def count_bayes(df: DataFrame, repr: str = "frequency", ngram: str = "unibi", text_col: str = "text", label_col: str = "label") -> BayesCounts:
    """The counts of labelled messages. Rows without a label are left out; a message without tokens counts as a message."""
    rows = df.filter(F.col(label_col).isNotNull())
    messages = rows.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    return BayesCounts(messages, stored(token_counts(rows, repr, ngram, text_col, label_col), "token-counts"), repr, ngram)  # several tables come from the counts


def bayes_model(counts: BayesCounts, alpha: float | str = 1.0) -> BayesModel:
    """Priors, totals and likelihoods of counts under one smoothing."""
    a = SMOOTHING[alpha] if isinstance(alpha, str) else float(alpha)
    priors = _priors(counts.messages)
    totals = class_totals(priors, counts.tokens, a)
    return BayesModel(priors, totals, likelihoods(counts.tokens, totals, a), counts.repr, counts.ngram)


def train_bayes(df: DataFrame, alpha: float | str = 1.0, repr: str = "frequency", ngram: str = "unibi", text_col: str = "text", label_col: str = "label") -> BayesModel:
    return bayes_model(count_bayes(df, repr, ngram, text_col, label_col), alpha)


def bayes_scores(df: DataFrame, model: BayesModel, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """row_id, label, score for each label that the model has: log prior and the log likelihoods of the message's tokens that it knows.

    score = prior + known tokens * default + sum over the label's own tokens of (log_prob - default). A token is one row of the model, with
    its gain for each label as a column, so messages meet it once, and one grouping sums all labels.
    """
    about = [tuple(r) for r in model.priors.join(model.totals, "label").select("label", "log_prior", "log_default").orderBy("label").collect()]  # a row a label
    kind = model.priors.schema["label"].dataType
    labels = [F.lit(label).cast(kind) for label, _, _ in about]
    gains = [F.sum(F.when(F.col("label") == label, F.col("log_prob") - F.lit(default))).alias(f"g{i}") for i, (label, (_, _, default)) in enumerate(zip(labels, about, strict=True))]
    wide = model.likelihood.groupBy("token").agg(F.lit(1).alias("one"), *gains)
    tokens = df.select(F.col(id_col).alias("_id"), F.explode(representation(ngrams(F.col(text_col), model.ngram), model.repr)).alias("token"))
    sums = tokens.join(wide, "token").groupBy("_id").agg(F.sum("one").alias("known"), *[F.sum(f"g{i}").alias(f"s{i}") for i in range(len(about))])
    rows = df.select(id_col).join(sums, F.col(id_col) == F.col("_id"), "left")
    score: list[Column] = [F.struct(label.alias("label"), (F.lit(prior) + F.coalesce("known", F.lit(0)) * F.lit(default) + F.coalesce(f"s{i}", F.lit(0.0))).alias("score")) for i, (label, (_, prior, default)) in enumerate(zip(labels, about, strict=True))]
    if not about:
        return df.select(id_col, F.lit(None).cast(kind).alias("label"), F.lit(None).cast("double").alias("score")).limit(0)
    return rows.select(id_col, F.explode(F.array(*score)).alias("s")).select(id_col, "s.label", "s.score")


def bayes_argmax(scores: DataFrame, id_col: str = "row_id") -> DataFrame:
    """row_id, estimated: the best label, comparing scores to 1e-9; the smaller label on ties."""
    best = scores.groupBy(id_col).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("label").alias("label"))).alias("b"))
    return best.select(id_col, F.col("b.label").alias("estimated"))


def classify_bayes(df: DataFrame, model: BayesModel, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """The rows with ``estimated``, in place of a column of that name."""
    return df.drop("estimated").join(bayes_argmax(bayes_scores(df, model, text_col, id_col), id_col), id_col, "left")

