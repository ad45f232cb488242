"""Robots texts: parsed to tables of rules and delays, and met by paths.

A text is lines of `field: value`. Agent lines that follow each other head one group, whose rules hold for all of them;
groups of one agent count together. A crawler obeys the groups whose agent name its own begins with
(longest name first), else those of `*`. Rules are patterns: `*` stands for any characters, `$` at the end for
the end of the path, anything else begins the path (with its query). The longest pattern that a path meets decides, and of
equally long ones the allowing one; a path that meets none is allowed.

A path is held against the rules of its host by the lengths that their fixed beginnings have there: it
makes a row for each such length, not for each of its characters, and meets rules by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a robots text that are read; the rest of a longer one is ignored.
MOST_CHARS = 512_000


def robots_lines(texts: DataFrame, host: str = "host", body: str = "body") -> DataFrame:
    """(host, at, field, value) of the lines that say something: comments cut off, fields in lower case."""
    line = F.posexplode(F.split(F.left(body, F.lit(MOST_CHARS)), r"\r\n|\r|\n")).alias("at", "line")
    cut = texts.select(F.col(host).alias("host"), line).withColumn("line", F.regexp_replace("line", "^\\x{FEFF}|#.*$", ""))
    parts = F.split("line", ":", 2)
    named = cut.where(F.size(parts) == 2).select("host", "at", F.lower(F.trim(F.regexp_replace(parts[0], r"\s", ""))).alias("field"), F.regexp_replace(parts[1], r"^\s+|\s+$", "").alias("value"))
    return named.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))


def robots_groups(texts: DataFrame, agent: str, host: str = "host", body: str = "body") -> DataFrame:
    """(host, at, field, value) of the lines that hold for an agent. Hosts are many and a text is short, so a host is one group."""
    in_host = Window.partitionBy("host").orderBy("at")
    lines = robots_lines(texts, host, body)
    heads = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(in_host), F.lit("")) != "user-agent")
    grouped = lines.withColumn("group", F.sum(heads.cast("int")).over(in_host.rowsBetween(Window.unboundedPreceding, 0)))
    mine = F.lit(agent.lower().split("/")[0].strip())
    name = F.lower(F.trim(F.split("value", "/", 2)[0]))
    # how well a group's agent names fit: characters of the name, 0 for *, null if not at all
    fit = F.when(name == "*", F.lit(0)).when((name != "") & F.startswith(mine, name), F.length(name))
    fits = grouped.where(F.col("field") == "user-agent").groupBy("host", "group").agg(F.max(fit).alias("fit")).where("fit is not null")
    best = fits.withColumn("best", F.max("fit").over(Window.partitionBy("host"))).where("fit = best").select("host", "group")
    return grouped.where(F.col("field") != "user-agent").join(best, ["host", "group"]).select("host", "at", "field", "value")


def robots_rules(texts: DataFrame, agent: str, host: str = "host", body: str = "body") -> DataFrame:
    """(host, pattern, allow) of the rules that hold for an agent. An empty pattern is no rule."""
    lines = robots_groups(texts, agent, host, body).where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return lines.groupBy("host", F.col("value").alias("pattern")).agg(F.bool_or(F.col("field") == "allow").alias("allow"))


def crawl_delays(texts: DataFrame, agent: str, least: float = 2.0, host: str = "host", body: str = "body") -> DataFrame:
    """(host, delay): seconds between requests, the first that is told for the agent, and `least` at least."""
    told = F.col("value").try_cast("double")
    lines = robots_groups(texts, agent, host, body).where((F.col("field") == "crawl-delay") & (told > 0))
    return lines.groupBy("host").agg(F.greatest(F.min_by(told, "at"), F.lit(least)).alias("delay"))


def meets(path: Column, pieces: Column, anchored: Column) -> Column:
    """Whether a path meets a pattern, given as its pieces between `*` and whether it ends with `$`.

    The first piece begins the path; each further one is sought from where the one before it ended; the last one of an anchored pattern ends the path.
    """
    first = F.element_at(pieces, 1)
    rest = F.when(anchored, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))).otherwise(F.slice(pieces, F.lit(2), F.size(pieces)))
    # where the path may go on, from 1; 0 once a piece is missing
    at = F.aggregate(rest, F.length(first) + 1, lambda at, p: F.when(at == 0, at).when(p == "", at).otherwise(F.coalesce(F.nullif(F.call_function("locate", p, path, at), F.lit(0)) + F.length(p), F.lit(0))))
    last = F.element_at(pieces, -1)
    ends = F.when(~anchored, F.lit(True)).when(F.size(pieces) == 1, path == first).otherwise(F.endswith(path, last) & (F.length(path) - F.length(last) + 1 >= at))
    return F.startswith(path, first) & (at > 0) & ends


def permitted(requests: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """requests with `allowed`, by the longest rule (host, pattern, allow) that the path meets; of equals the allowing one. A null host or path is allowed."""
    anchored = F.col("pattern").endswith("$")
    whole = F.when(anchored, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    cut = rules.select(F.col("host").alias("__h"), "allow", F.length("pattern").alias("__size"), F.split(whole, r"\*+").alias("__pieces"), anchored.alias("__anchored"))
    cut = cut.withColumn("__begin", F.element_at("__pieces", 1))
    # a host has few lengths, whatever its rules
    lengths = cut.groupBy("__h").agg(F.collect_set(F.length("__begin")).alias("__lengths"))
    asked = requests.select(F.col(host).alias("__h"), F.col(path).alias("__path")).where("__h is not null and __path is not null").distinct()
    fitting = F.filter("__lengths", lambda n: n <= F.length("__path"))
    begins = asked.join(lengths, "__h").select("__h", "__path", F.explode(fitting).alias("__n")).withColumn("__begin", F.left("__path", F.col("__n")))
    met = begins.join(cut, ["__h", "__begin"]).where(meets(F.col("__path"), F.col("__pieces"), F.col("__anchored")))
    best = met.groupBy("__h", "__path").agg(F.max_by("allow", F.struct("__size", "allow")).alias("__allowed"))
    joined = requests.join(best, (F.col(host) == F.col("__h")) & (F.col(path) == F.col("__path")), "left")
    return joined.withColumn("allowed", F.coalesce("__allowed", F.lit(True))).select(*requests.columns, "allowed")
