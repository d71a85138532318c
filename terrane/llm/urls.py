"""URL filtering by rules and, where no rule fits, by the reputation of the host.

Pages that a rule fits are labelled outcomes. They are added up by host, and shrunk by a chain of
beta-binomial priors: the suffix's rate has the pooled rate as its prior mean, the registered
domain's the suffix's, and the host's the domain's. Each level's prior strength is fitted to the data:
the less the rates of a level differ beyond chance, the more they are drawn to their parents'. A page without a rule is blocked if the lower
posterior bound of its host's rate is above ``BLOCK_RATE``. Labels come from rules that may name one
path of a host, so pages without a rule count as good by ``UNLABELLED``: a host isn't judged by its
blocked path alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import bounded
from terrane.operators.lineage import cut

#: (rule, verdict): host, then the path that a url's path must start with.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UNLABELLED, BLOCK_RATE, Z = 0.5, 0.5, 1.0
STRENGTHS = (1.0, 1000.0)
#: Second labels that make a suffix of two labels with a country's label of two letters, as in co.uk (fixed values).
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' if null or none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules=RULES) -> DataFrame:
    """rule, verdict, rule_host, rule_path."""
    made = spark.createDataFrame([tuple(r) for r in rules], "rule string, verdict string")
    at = F.locate("/", F.col("rule"))
    return made.select("rule", "verdict", F.lower(F.expr("substring(rule, 1, locate('/', rule) - 1)")).alias("rule_host"), F.expr("substring(rule, locate('/', rule))").alias("rule_path")).where(at > 0)


def suffixes(host: str, labels: int) -> str:
    """SQL for the host and its parent domains, as far as they have at most ``labels`` labels: longer ones fit no rule."""
    return f"transform(sequence(1, least({labels}, size(split({host}, '[.]')))), k -> substring_index({host}, '.', -k))"


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where they are a country's suffix such as co.uk."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.rlike(rf"\A({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}\z"), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it; a host without such a label is its own domain."""
    return F.when(F.contains(suffix, F.lit(".")), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _strength(children: DataFrame) -> float:
    """The beta prior's strength for rates (bad of n) around their parents' (parent_bad of parent_n), by moments.

    The spread of the children's rates is compared with what chance gives at strength infinity and at 0.
    """
    rated = children.where("n > 0 and parent_n > 0").select("bad", "n", F.try_divide("bad", "n").alias("r"), F.try_divide("parent_bad", "parent_n").alias("m"), (1 - F.try_divide("n", "parent_n")).alias("free"))
    v = F.col("m") * (1 - F.col("m")) * F.col("free")
    spread, chance, most = rated.agg(F.sum(F.col("n") * F.pow(F.col("r") - F.col("m"), F.lit(2.0))), F.sum(v), F.sum(v * F.greatest(F.col("n") - 1, F.lit(0.0)))).first()
    if not most or spread <= chance:
        return STRENGTHS[1]
    return min(STRENGTHS[1], max(STRENGTHS[0], most / (spread - chance) - 1))


def reputation(outcomes: DataFrame) -> DataFrame:
    """From host, bad, n (doubles; one row per host): host, rate, lower, by the chain of priors.

    Weight-free inputs (n = 0 everywhere) get a rate of 0.
    """
    named = outcomes.withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    domains = cut(named.groupBy("domain", "suffix").agg(*sums))
    tops = cut(domains.groupBy("suffix").agg(*sums))
    bad, n = tops.agg(*sums).first()
    bad, n = bad or 0.0, n or 0.0
    parent = lambda frame: frame.withColumnsRenamed({"bad": "parent_bad", "n": "parent_n"})
    of_tops = _strength(tops.select("*", F.lit(bad).alias("parent_bad"), F.lit(n).alias("parent_n")))
    of_domains = _strength(domains.join(parent(tops), "suffix"))
    of_hosts = _strength(named.join(parent(domains), ["domain", "suffix"]))
    shrunk = lambda mean, strength: (F.col("bad") + strength * mean) / (F.col("n") + strength)
    top_rates = tops.select("suffix", shrunk(F.lit(bad / n if n else 0.0), of_tops).alias("suffix_rate"))
    domain_rates = domains.join(top_rates, "suffix").select("domain", "suffix", shrunk(F.col("suffix_rate"), of_domains).alias("domain_rate"))
    rated = named.join(domain_rates, ["domain", "suffix"]).withColumn("rate", shrunk(F.col("domain_rate"), of_hosts))
    return rated.select("host", "rate", F.expr(f"rate - {Z} * sqrt(rate * (1 - rate) / (n + {of_hosts + 1!r}D))").alias("lower"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id_col, host, path, rule (null if none fits), verdict, host_rate, host_bound.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins,
    then the least in code point order. A null url, or one without ``://``, has an empty host and path:
    no rule fits and it is allowed with the pages of other empty hosts. Repeated rows are returned
    each; other columns are left out. An empty table gives no rows, and without rules all are allowed.
    """
    parsed = cut(pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    hosts = parsed.select("host").distinct()
    labels = rules.agg(F.max(F.size(F.split("rule_host", "[.]")))).first()[0] or 1
    fitting = (
        hosts.select("host", F.explode(F.expr(suffixes("host", labels))).alias("rule_host")).join(rules, "rule_host")
        .groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("n"), "rule", "verdict", "rule_path")).alias("rules"))
    )
    ruled = parsed.join(bounded(cut(fitting)), "host", "left").withColumn("best", F.expr(
        "array_sort(filter(rules, r -> startswith(path, r.rule_path)), (a, b) -> case when a.n > b.n then -1 when a.n < b.n then 1"
        " when a.rule < b.rule then -1 when a.rule > b.rule then 1 else 0 end)"
    )).select("id", "host", "path", F.expr("get(best, 0).rule").alias("rule"), F.expr("get(best, 0).verdict").alias("by_rule"))
    ruled = cut(ruled)
    outcomes = ruled.groupBy("host").agg(
        F.sum(F.expr("if(by_rule = 'block', 1D, 0D)")).alias("bad"), F.sum(F.expr(f"if(by_rule is null, {UNLABELLED}D, 1D)")).alias("n")
    )
    judged = ruled.join(bounded(cut(reputation(cut(outcomes)))), "host", "left")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.expr(f"coalesce(by_rule, if(host <> '' and lower > {BLOCK_RATE}, 'block', 'allow'))").alias("verdict"),
        F.col("rate").alias("host_rate"), F.col("lower").alias("host_bound"),
    )
