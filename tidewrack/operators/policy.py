"""Politeness and resilience: robots rules, delays, retries, circuit breakers.

Folds over a domain's ordered events are compositions of partial folds over runs of bounded size
(delays, schedules, circuit breakers), so a dominating domain's history is never in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.config import PolicyConfig, RetryConfig
from tidewrack.operators.ordered import runs


def classify_error(kind: Column, status: Column, message: Column) -> Column:
    """Type of an error. kind names a timeout or connection error; a status decides next; only without
    one does the message."""
    m = F.coalesce(F.lower(message), F.lit(""))
    has = F.coalesce(status, F.lit(0)) != 0
    return (
        F.when(kind.isin("network_timeout", "connection_error"), kind)
        .when(has & (status == 429), "rate_limited").when(has & status.between(400, 499), "http_client_error")
        .when(has & status.between(500, 599), "http_server_error").when(has, "unknown_error")
        .when(m.contains("parsing"), "parsing_error").when(m.contains("screenshot"), "screenshot_error")
        .when(m.contains("storage"), "storage_error").otherwise("unknown_error")
    )


def is_retryable(kind: Column, attempt: Column, cfg: RetryConfig = RetryConfig()) -> Column:
    return F.coalesce((attempt < cfg.max_attempts) & kind.isin(list(cfg.retryable)), F.lit(False))


def backoff(kind: Column, attempt: Column, cfg: RetryConfig = RetryConfig(), jitter: Column | None = None) -> Column:
    """Seconds before the next attempt; jitter (0 to 1) adds up to a tenth, after the cap."""
    d = F.lit(cfg.base_delay) * F.pow(F.lit(cfg.exponential_base), attempt - 1)
    d = F.least(F.when(kind == "rate_limited", d * 2).otherwise(d), F.lit(cfg.max_delay))
    return d if jitter is None else d + d * 0.1 * jitter


def retry_schedule(errors: DataFrame, kind: Column, cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """errors with one row per attempt that its type allows: attempt, delay after it, seconds since
    the first."""
    steps = F.when(kind.isin(list(cfg.retryable)), F.sequence(F.lit(1), F.lit(cfg.max_attempts))).otherwise(F.array(F.lit(1)))
    r = errors.withColumn("_k", kind).withColumn("retry", F.explode(steps))
    last = (F.col("retry") == cfg.max_attempts) | ~F.col("_k").isin(list(cfg.retryable))
    waited = F.aggregate(F.sequence(F.lit(1), F.col("retry")), F.lit(0.0), lambda s, i: s + F.when(i < F.col("retry"), backoff(F.col("_k"), i, cfg)).otherwise(0.0))
    return r.withColumns({"delay": F.when(last, None).otherwise(backoff(F.col("_k"), F.col("retry"), cfg)), "waited": waited}).drop("_k")


def _step(delay: Column, status: Column, seconds: Column, default: float) -> Column:
    s, t = F.coalesce(status, F.lit(0)), F.coalesce(seconds, F.lit(0.0))
    return (
        F.when(s == 429, delay * 2.0).when(s >= 500, delay * 1.5).when(t > 10, delay * 1.2)
        .when((s == 200) & (t < 2), F.greatest(F.lit(default), delay * 0.95)).otherwise(delay)
    )


def adaptive_delay(events: DataFrame, order: list[str], cfg: PolicyConfig = PolicyConfig(), domain: str = "domain", initial: float | None = None) -> DataFrame:
    """(domain, crawl_delay, requests) after all events(domain, status_code, response_time) in order:
    429 doubles the delay, 5xx x 1.5, more than 10 s x 1.2, fast success x 0.95 down to the default.
    The exact fold, for histories that fit an array."""
    d0 = cfg.default_delay if initial is None else initial
    g = events.groupBy(domain).agg(F.array_sort(F.collect_list(F.struct(*order, "status_code", "response_time"))).alias("h"))
    fold = F.aggregate("h", F.lit(float(d0)), lambda d, e: _step(d, e["status_code"], e["response_time"], cfg.default_delay))
    return g.select(domain, fold.alias("crawl_delay"), F.size("h").alias("requests"))


def adaptive_delay_closed(events: DataFrame, order: list[str], cfg: PolicyConfig = PolicyConfig(), domain: str = "domain", rows: int | None = None) -> DataFrame:
    """adaptive_delay for histories of any length. An event maps x to max(c, a x); such maps compose
    to such maps, so each run of bounded size is folded to one (a, c), and a domain's runs in turn."""
    s, t = F.coalesce("status_code", F.lit(0)), F.coalesce("response_time", F.lit(0.0))
    fast = (s != 429) & (s < 500) & (t <= 10) & (s == 200) & (t < 2)
    a = F.when(s == 429, 2.0).when(s >= 500, 1.5).when(t > 10, 1.2).when(fast, 0.95).otherwise(1.0)
    c = F.when(fast, float(cfg.default_delay)).otherwise(0.0)
    r = runs(events.select(F.col(domain).alias("domain"), *order, a.alias("a"), c.alias("c")), order, ["domain"], rows)
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"))
    join = lambda x, y: F.struct((x["a"] * y["a"]).alias("a"), F.greatest(y["c"], y["a"] * x["c"]).alias("c"))
    part = r.groupBy("domain", "_b").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), "a", "c"))).alias("h"))
    part = part.select("domain", "_b", F.size("h").alias("n"), F.aggregate("h", one, join).alias("m"))
    whole = part.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("_b", "m"))).alias("h"), F.sum("n").alias("requests"))
    m = F.aggregate(F.transform("h", lambda x: x["m"]), one, join)
    return whole.select("domain", F.greatest(m["c"], m["a"] * cfg.default_delay).alias("crawl_delay"), "requests")


def politeness_schedule(requests: DataFrame, arrival: Column, delay: Column, order: list[str], domain: str = "domain", rows: int | None = None) -> DataFrame:
    """requests with start: each at its arrival or `delay` seconds after the one before on its domain.

    The recurrence unrolls to i x delay + running max(arrival - i x delay). Index and maximum run
    within runs of bounded size; the runs before on the domain, few, add their count and maximum.
    """
    r = runs(requests.withColumns({"_a": arrival, "_d": delay}), order, [domain], rows)
    w = Window.partitionBy(domain, "_b").orderBy(*order)
    r = r.withColumn("_i", F.row_number().over(w) - 1)
    before = Window.partitionBy(domain).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = r.groupBy(domain, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("_a") - F.col("_i") * F.col("_d")).alias("_m"), F.first("_d").alias("_dd"))
    per = per.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per = per.withColumn("_p", F.max(F.col("_m") - F.col("_o") * F.col("_dd")).over(before)).select(domain, "_b", "_o", "_p")
    r = r.join(per, [domain, "_b"]).withColumn("_j", F.col("_i") + F.col("_o"))
    run = F.max(F.col("_a") - F.col("_j") * F.col("_d")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.col("_j") * F.col("_d") + F.greatest(run, F.coalesce("_p", run))
    return r.withColumn("start", start).drop("_a", "_d", "_i", "_b", "_o", "_p", "_j")


class Breaker:
    """State of a circuit breaker: closed, open or half_open."""

    def __init__(self, cfg: PolicyConfig, state: str = "closed", failures: int = 0, last: float = 0.0):
        self.cfg, self.state, self.failures, self.last = cfg, state, failures, last

    def event(self, at: float, ok: bool) -> bool:
        """Feed an event; False if the breaker refuses the call. It opens after enough failures,
        refuses until the recovery time has passed, then lets one try; a success closes it only then,
        and doesn't reset the count while it is closed."""
        if self.state == "open":
            if not at - self.last > self.cfg.recovery_seconds:
                return False
            self.state = "half_open"
        if ok:
            if self.state == "half_open":
                self.state, self.failures = "closed", 0
        else:
            self.failures, self.last = self.failures + 1, at
            if self.failures >= self.cfg.failure_threshold:
                self.state = "open"
        return True


def _run_summary(times: list[float], oks: list[bool], cfg: PolicyConfig) -> tuple[list[tuple], list[float], list[tuple]]:
    """What a run of events does to a breaker, whatever state it begins in.

    Results are (state, failures, last, refused, added): failures of an open start are counted from the
    start's own where added is true. The first list has those of starts closed with 0, 1, ... failures.
    For an open start with last failure L the first event after L + recovery is the next try: the second
    list has the times of the events that can be it, as L isn't after the run's first event, and the third
    the result of a try there. Without a try the breaker stays open."""
    n, gap, most = len(times), cfg.recovery_seconds, cfg.failure_threshold

    after = [n] * n  # the first event that an event's failure leaves to try
    k = 0
    for i in range(n):
        if times[i] != times[i]:
            continue  # no time, no recovery
        k = max(k, i + 1)
        while k < n and not times[k] - times[i] > gap:
            k += 1
        after[i] = k
    tries: list[tuple | None] = [None] * (n + 1)
    fails = [i for i in range(n) if not oks[i]]
    rank = [0] * (n + 1)  # failures before an event
    for i in range(n):
        rank[i + 1] = rank[i] + (not oks[i])

    def opened(i: int, failures: int, added: bool) -> tuple:
        """From an event that failed and opened the breaker."""
        if after[i] >= n:
            return ("open", failures, times[i], n - 1 - i, added)
        s, f, last, refused, add = tries[after[i]]
        return (s, f + failures if add else f, last, refused + after[i] - 1 - i, added if add else False)

    def closed(i: int, failures: int, last: float) -> tuple:
        """From before an event, closed with some failures."""
        j = rank[i] + most - failures - 1
        if j >= len(fails):
            return ("closed", failures + len(fails) - rank[i], times[fails[-1]] if len(fails) > rank[i] else last, 0, False)
        return opened(fails[j], most, False)

    for i in range(n - 1, -1, -1):
        tries[i] = closed(i + 1, 0, times[i]) if oks[i] else opened(i, 1, True)
    starts = [closed(0, f, None) for f in range(most)]
    can = [] if times[0] != times[0] else [i for i in range(n) if i == 0 or not times[i - 1] - times[0] > gap]
    known = lambda x: (x[0], x[1], None if x[2] is None or x[2] != x[2] else x[2], x[3], x[4])
    return [known(x) for x in starts], [times[i] for i in can], [known((*tries[i][:3], tries[i][3] + i, tries[i][4])) for i in can]


def breaker_states(events: DataFrame, order: list[str], seconds: str, ok: str, cfg: PolicyConfig = PolicyConfig(), key: str = "domain", rows: int | None = None) -> DataFrame:
    """(key, state, failures, refused): the circuit breaker of each key after its events in order. Null
    times never let an open breaker recover, and come first.

    A run of bounded size is reduced to what it does from each state that it can begin in (closed with so
    many failures, or open since the last one), and a key's runs, few, are composed in turn, so no task
    holds a key's events."""
    kind = events.schema[key].dataType.simpleString()
    narrow = events.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(seconds).cast("double").alias("t"), F.col(ok).alias("ok"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    names = [f"_o{i}" for i in range(len(order))]
    r = runs(narrow, names, ["k"], rows)
    result = "struct<state: string, failures: int, last: double, refused: bigint, added: boolean>"

    def summarise(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # all keys of a run at once: most keys have few events
        pdf = pdf.sort_values(names, na_position="first", kind="stable")
        fields, out = ("state", "failures", "last", "refused", "added"), []
        for k, part in pdf.groupby("k", sort=False):
            starts, at, tries = _run_summary(part["t"].tolist(), part["ok"].astype(bool).tolist(), cfg)
            out.append((k, group[0], len(part), [dict(zip(fields, x)) for x in starts], at, [dict(zip(fields, x)) for x in tries]))
        return pd.DataFrame(out, columns=["k", "_b", "n", "starts", "at", "tries"])

    per = r.groupBy("_b").applyInPandas(summarise, f"k {kind}, _b int, n bigint, starts array<{result}>, at array<double>, tries array<{result}>")
    folded = per.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("_b", "n", "starts", "at", "tries"))).alias("runs"))
    zero = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("bigint").alias("refused"))

    def step(s: Column, run: Column) -> Column:
        # the first of the events that may be the next try
        tried = F.array_position(F.transform(run["at"], lambda t: F.coalesce(t - s["last"] > cfg.recovery_seconds, F.lit(False))), True)
        open_now = s["state"] == "open"
        found = F.when(~open_now, F.get(run["starts"], s["failures"])).when(tried > 0, F.get(run["tries"], (tried - 1).cast("int")))
        none = found.isNull()
        return F.struct(
            F.when(none, s["state"]).otherwise(found["state"]).alias("state"),
            F.when(none, s["failures"]).otherwise(found["failures"] + F.when(found["added"], s["failures"]).otherwise(0)).cast("int").alias("failures"),
            F.when(none, s["last"]).otherwise(F.coalesce(found["last"], s["last"])).alias("last"),
            (s["refused"] + F.when(none, run["n"]).otherwise(found["refused"])).cast("bigint").alias("refused"),
        )

    m = F.aggregate("runs", zero, step)
    return folded.select(F.col("k").alias(key), m["state"].alias("state"), m["failures"].alias("failures"), m["refused"].cast("int").alias("refused"))


def robots_policy(robots: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """(domain, crawl_delay, user_agent_allowed) of robots(domain, robots_txt). Rules count under the
    latest user-agent line if it is * or holds the whole lower-case agent name; `disallow: /` bars the
    agent, the last valid crawl-delay counts, at least the default. No text: the defaults."""
    ua = cfg.user_agent.lower()
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    start = F.struct(F.lit(None).cast("string").alias("agent"), F.lit(cfg.default_delay).alias("delay"), F.lit(True).alias("allowed"))

    def step(s: Column, raw: Column) -> Column:
        line = strip(raw)
        value = strip(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
        mine = F.coalesce((s["agent"] != "") & ((s["agent"] == "*") | s["agent"].contains(ua)), F.lit(False))
        number = F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), value.try_cast("double"))
        agent = F.when(line.startswith("user-agent:"), value).otherwise(s["agent"])
        delay = F.when(line.startswith("crawl-delay:") & mine & number.isNotNull(), F.greatest(number, F.lit(cfg.default_delay))).otherwise(s["delay"])
        allowed = s["allowed"] & ~(line.startswith("disallow:") & mine & (value == "/"))
        return F.struct(agent.alias("agent"), delay.alias("delay"), allowed.alias("allowed"))

    r = F.aggregate(F.split(F.lower(F.coalesce("robots_txt", F.lit(""))), "\n"), start, step)
    return robots.select("domain", r["delay"].alias("crawl_delay"), r["allowed"].alias("user_agent_allowed"))


def robots_gate(urls: DataFrame, robots: DataFrame, blocked: list[str] = (), cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """urls(url, domain) with can_crawl and reason: domain blocked, agent barred, or path disallowed
    by the standard library's reading of the stored robots text."""
    ua = cfg.user_agent

    @F.pandas_udf("boolean")
    def can_fetch(text: pd.Series, url: pd.Series) -> pd.Series:
        from urllib.robotparser import RobotFileParser

        known: dict[str, RobotFileParser] = {}
        out = []
        for t, u in zip(text, url):
            if not t:
                out.append(True)
                continue
            if t not in known:
                known[t] = RobotFileParser()
                known[t].parse(t.splitlines())
            out.append(known[t].can_fetch(ua, u or ""))
        return pd.Series(out)

    policy = robots_policy(robots, cfg).join(robots.select("domain", "robots_txt"), "domain")
    j = urls.join(policy, "domain", "left")
    reason = (
        F.when(F.col("domain").isin(list(blocked)), F.concat(F.lit("Domain "), "domain", F.lit(" is blocked")))
        .when(~F.coalesce("user_agent_allowed", F.lit(True)), F.lit(f"User agent {ua} not allowed by robots.txt"))
        .when(~can_fetch(F.coalesce("robots_txt", F.lit("")), "url"), F.lit("URL blocked by robots.txt")).otherwise("OK")
    )
    return j.withColumn("reason", reason).withColumn("can_crawl", F.col("reason") == "OK").drop("robots_txt", "user_agent_allowed")
