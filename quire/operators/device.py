"""Rules of the device client, over tables of transcripts, inventories and routes. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import commands as C

# The order of operations, and the variable that holds a password where nothing else does.
OPERATIONS = ("show", "backup", "config", "save")
DEFAULT_PASSWORD = "IX_PASS"


def _first(*names: str) -> Column:
    """The first of the map's values under these names that isn't empty."""
    return F.coalesce(*(F.nullif(F.try_element_at("entry", F.lit(n)), F.lit("")) for n in names))


def entry_host() -> Column:
    return _first("host", "hostname", "address", "ip")


def entry_user() -> Column:
    return _first("username", "user")


def executed(transcript: DataFrame) -> DataFrame:
    """Adds `status` to rows (session, seq, op, command, output): occupied, failed, ok, or skipped after the first failure of the session."""
    status = F.when(F.col("op") == "config", F.when(C.command_error(F.col("command"), F.col("output")), F.lit("failed")).otherwise(F.lit("ok"))).otherwise(C.output_status(F.col("command"), F.col("output")))
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    t = transcript.withColumn("_s", status)
    stopped = F.coalesce(F.max(F.col("_s") != "ok").over(w), F.lit(False))
    return t.withColumn("status", F.when(stopped, F.lit("skipped")).otherwise(F.col("_s"))).drop("_s")


def targets(requests: DataFrame, inventory: DataFrame, ssh: DataFrame) -> DataFrame:
    """Rows (id, alias, host, user, port, error) from requests (id, device, host, user, port), entries (name, entry map) and ssh (alias, hostname, user, port).

    Flags come before the entry, the entry before the ssh configuration; the port is 22 in the end. A device that the
    inventory lacks, or a request without device and host, is an error, told in its own row.
    """
    t = requests.select("id", "device", *(F.nullif(F.col(c), F.lit("")).alias(f"f_{c}") for c in ("host", "user", "port")))
    t = t.join(inventory, t["device"] == inventory["name"], "left")
    asked = F.coalesce("f_host", entry_host(), F.nullif("device", F.lit("")))
    t = t.withColumn("asked", asked)
    s = ssh.select("alias", *(F.nullif(F.col(c), F.lit("")).alias(f"s_{c}") for c in ("hostname", "user", "port")))
    t = t.join(s, t["asked"] == s["alias"], "left")
    error = F.when((F.col("device") != "") & F.col("name").isNull() & F.col("f_host").isNull(), F.concat(F.lit("unknown device "), "device")).when(F.col("asked").isNull(), F.lit("no device and no host"))
    port = F.coalesce("f_port", _first("port"), "s_port", F.lit("22")).try_cast("int")
    error = F.coalesce(error, F.when(port.isNull() | ~port.between(1, 65535), F.lit("bad port")))
    value = lambda c: F.when(error.isNull(), c)
    return t.select("id", value(F.coalesce(F.nullif("device", F.lit("")), "asked")).alias("alias"), value(F.coalesce("s_hostname", "asked")).alias("host"), value(F.coalesce("f_user", entry_user(), "s_user", F.lit(""))).alias("user"), value(port).alias("port"), error.alias("error"))


def auth_source(flag: Column, env: Column) -> Column:
    """Where a password comes from, never the password: the named variable (error where empty), the entry, the entry's variable, the default variable."""
    get = lambda k: F.nullif(F.try_element_at(env, k), F.lit(""))
    return (
        F.when(flag != "", F.when(get(flag).isNotNull(), F.concat(F.lit("variable "), flag)).otherwise(F.concat(F.lit("error: empty variable "), flag)))
        .when(_first("password").isNotNull(), F.lit("inventory"))
        .when(get(_first("password_env")).isNotNull(), F.concat(F.lit("variable "), _first("password_env")))
        .when(get(F.lit(DEFAULT_PASSWORD)).isNotNull(), F.lit(f"variable {DEFAULT_PASSWORD}"))
        .otherwise(F.lit("none"))
    )


def device_list(rows: DataFrame) -> DataFrame:
    """Rows (name, host, user, auth, route_error) as lines of equal columns; an error of one row leaves the others alone."""
    w = Window.partitionBy(F.lit(1))
    cols = ("name", "host", "user", "auth")
    t = rows.withColumns({f"_{c}": F.max(F.length(F.coalesce(c, F.lit("-")))).over(w) for c in cols})
    cell = lambda c: F.rpad(F.coalesce(c, F.lit("-")), F.col(f"_{c}"), " ")
    end = F.when(F.col("route_error").isNotNull(), F.concat(F.lit("route error: "), "route_error")).otherwise("")
    return t.select("name", F.rtrim(F.concat_ws("  ", *(cell(c) for c in cols), end)).alias("line"))


def split_hop(spec: Column) -> Column:
    """struct<user, host, port, error> of `[user@]host[:port]`, cut at the last @; a port only where there is just one colon."""
    s = F.trim(spec)
    at = F.length(s) - F.locate("@", F.reverse(s)) + 1
    has = F.contains(s, F.lit("@"))
    user = F.when(has, F.substring(s, F.lit(1), at - 1)).otherwise("")
    rest = F.when(has, F.substring(s, at + 1, F.length(s))).otherwise(s)
    one = F.regexp_count(rest, F.lit(":")) == 1
    port = F.when(one, F.substring_index(rest, ":", -1)).otherwise("")
    host = F.when(one, F.substring_index(rest, ":", 1)).otherwise(rest)
    bad = (port != "") & (~port.rlike(r"^\d{1,5}\z") | (port.try_cast("int") > 65535) | (port.try_cast("int") < 1))
    error = F.when(host == "", F.lit("no host")).when(bad | (one & (port == "")), F.lit("bad port"))
    return F.struct(user.alias("user"), host.alias("host"), port.try_cast("int").alias("port"), error.alias("error"))


def jump_routes(spark: SparkSession, hosts: DataFrame) -> DataFrame:
    """Rows (host, step, hop): each host's jump hosts, outermost first, from rows (host, proxyjump). `none` ends; a hop met before is left out, so cycles end.

    A recursive query over the hops' places: a hop's own jumps come before it. A chain beyond the session's
    spark.sql.cteRecursionLevelLimit (100 unless set) is an error, none is cut.
    """
    jumps = hosts.where("proxyjump <> '' and lower(trim(proxyjump)) <> 'none'").select("host", F.posexplode(F.split("proxyjump", ",")).alias("pos", "spec"))
    jumps = jumps.select("host", F.trim("spec").alias("hop"), "pos").withColumn("name", F.regexp_replace(F.regexp_replace("hop", "^.*@", ""), ":[0-9]+$", ""))
    return spark.sql(
        """
with recursive r(host, hop, at, way, place) as (
  select host, hop, name, array(host, name), array(pos) from {jumps} where name <> host
  union all
  select r.host, j.hop, j.name, concat(r.way, array(j.name)), concat(r.place, array(j.pos)) from r join {jumps} j on j.host = r.at where not array_contains(r.way, j.name)),
f as (select host, at, min_by(hop, concat(place, array(2147483647))) hop, min(concat(place, array(2147483647))) place from r group by host, at)
select host, cast(row_number() over (partition by host order by place) as int) step, hop from f""",
        jumps=jumps,
    )


def applies(alias: Column, patterns: Column) -> Column:
    """Does the alias match one of the patterns (`*` any characters, `?` one) and none of those with `!` in front?"""
    regex = lambda p: F.concat(F.lit(r"\A(?s:"), F.replace(F.replace(F.regexp_replace(p, r"([^\w*?])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r")\z"))
    bars = lambda p: F.startswith(p, F.lit("!"))
    yes = F.exists(patterns, lambda p: ~bars(p) & F.rlike(alias, regex(p)))
    return yes & ~F.exists(patterns, lambda p: bars(p) & F.rlike(alias, regex(F.substring(p, F.lit(2), F.length(p)))))


def effective_ssh(directives: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows (alias, hostname, user, port, proxyjump, error) for each alias of hosts, from directives (patterns, ord, key, value).

    Of all directives that apply to the alias the first of each key holds. The first of ProxyJump and ProxyCommand rules out the
    other, but a jump of `none` doesn't; a command other than none is an error. A configuration is small, so its blocks go to every alias.
    """
    keys = ("hostname", "user", "port", "proxyjump", "proxycommand")
    d = directives.withColumn("key", F.lower("key")).where(F.col("key").isin(*keys))
    blocks = d.groupBy("patterns").agg(F.collect_list(F.struct("ord", "key", "value")).alias("own"))
    names = hosts.select("alias").distinct()
    own = names.join(F.broadcast(blocks), applies(F.col("alias"), F.col("patterns"))).select("alias", F.explode("own").alias("x")).select("alias", "x.*")
    first = own.groupBy("alias").agg(*(F.min(F.when(F.col("key") == k, F.struct("ord", "value"))).alias(k) for k in keys))
    value = lambda k: F.coalesce(F.col(f"{k}.value"), F.lit(""))
    jumps = F.coalesce(F.lower(F.trim("proxyjump.value")) != "none", F.lit(False))
    command = F.col("proxycommand").isNotNull() & (~jumps | (F.col("proxycommand.ord") < F.col("proxyjump.ord")))
    error = F.when(command & (F.lower("proxycommand.value") != "none"), F.lit("ProxyCommand is unsupported"))
    out = first.select("alias", value("hostname").alias("hostname"), value("user").alias("user"), value("port").alias("port"), F.when(command, F.lit("")).otherwise(value("proxyjump")).alias("proxyjump"), error.alias("error"))
    return names.join(out, "alias", "left").fillna("", ["hostname", "user", "port", "proxyjump"])
