"""Queries of element-wise, string, date and nested functions: one made column for every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.datetimes import to_datetime
from ..functions.nested import collect_kv, extract_kv, flatjson
from .registry import column

# ---- arithmetic, comparison, logic (orders)
P, K = "o_totalprice", "o_custkey"
N = f"nullif({P} > 250000, false)"
for name, kind, make, sql in [
    ("add", "f", lambda f: f[P] + f[K], f"{P} + {K}"),
    ("radd", "f", lambda f: 10 + f[P], f"10 + {P}"),
    ("sub", "f", lambda f: f[P] - f[K], f"{P} - {K}"),
    ("rsub", "f", lambda f: 1000 - f[P], f"1000 - {P}"),
    ("mul", "f", lambda f: f[P] * 2, f"{P} * 2"),
    ("rmul", "f", lambda f: 3 * f[P], f"3 * {P}"),
    ("truediv", "f", lambda f: f[P] / f[K], f"{P} / nullif({K}, 0)"),
    ("rtruediv", "f", lambda f: 7 / f[P], f"7 / {P}"),
    ("floordiv", "f", lambda f: f[P] // -7, f"floor({P} / -7)"),
    ("rfloordiv", "f", lambda f: 1e9 // f[P], f"floor(1e9 / {P})"),
    ("mod", "f", lambda f: f[K] % -7, f"{K} - floor({K} / -7.0) * -7"),
    ("rmod", "f", lambda f: 100 % f[K], f"100 - floor(100.0 / nullif({K}, 0)) * {K}"),
    ("pow", "f", lambda f: (f[K] % 10) ** 2, f"pow({K} % 10, 2)"),
    ("rpow", "f", lambda f: 2 ** (f[K] % 10), f"pow(2, {K} % 10)"),
    ("add_fill_value", "f", lambda f: f[P].where(f[P] > 250000).add(f[K].where(f[K] > 500), fill_value=0), f"CASE WHEN {P} > 250000 OR {K} > 500 THEN coalesce(CASE WHEN {P} > 250000 THEN {P} END, 0) + coalesce(CASE WHEN {K} > 500 THEN {K} END, 0) END"),
    ("neg", "f", lambda f: -f[P], f"-{P}"),
    ("abs", "f", lambda f: (f[P] - 250000).abs(), f"abs({P} - 250000)"),
    ("round", "f", lambda f: f[P].round(1), f"round_even({P}, 1)"),
    ("eq", "b", lambda f: f["o_orderstatus"] == "F", "o_orderstatus = 'F'"),
    ("ne_missing", "b", lambda f: f["o_orderstatus"].mask(f["o_orderstatus"] == "F") != "O", "coalesce(nullif(o_orderstatus, 'F') <> 'O', true)"),
    ("lt_missing", "b", lambda f: f[P].where(f[P] > 250000) < 300000, f"coalesce(CASE WHEN {P} > 250000 THEN {P} END < 300000, false)"),
    ("le", "b", lambda f: f[P] <= 250000, f"{P} <= 250000"),
    ("gt", "b", lambda f: f[P] > f[K] * 300, f"{P} > {K} * 300"),
    ("ge", "b", lambda f: f[P] >= 100000, f"{P} >= 100000"),
    ("and", "b", lambda f: (f[P] > 100000) & (f[K] < 500), f"{P} > 100000 AND {K} < 500"),
    ("or", "b", lambda f: (f[P] > 400000) | (f[K] < 100), f"{P} > 400000 OR {K} < 100"),
    ("xor", "b", lambda f: (f[P] > 250000) ^ (f[K] < 500), f"({P} > 250000) <> ({K} < 500)"),
    ("invert", "b", lambda f: ~(f[P] > 250000), f"NOT ({P} > 250000)"),
    ("bitand", "i", lambda f: f[K] & 12, f"{K} & 12"),
    ("bitor", "i", lambda f: f[K] | 12, f"{K} | 12"),
    ("bitxor", "i", lambda f: f[K] ^ 12, f"xor({K}, 12)"),
    ("bitinvert", "i", lambda f: ~f[K], f"~{K}"),
    ("between", "b", lambda f: f[P].between(1e5, 2e5, "left"), f"{P} >= 1e5 AND {P} < 2e5"),
    ("isin", "b", lambda f: f["o_orderpriority"].isin(["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("isna", "b", lambda f: f["o_orderstatus"].mask(f["o_orderstatus"] == "P").isna(), "nullif(o_orderstatus, 'P') IS NULL"),
    ("notna", "b", lambda f: f["o_orderstatus"].mask(f["o_orderstatus"] == "P").notna(), "nullif(o_orderstatus, 'P') IS NOT NULL"),
    ("fillna", "s", lambda f: f["o_orderstatus"].mask(f["o_orderstatus"] == "P").fillna("none"), "coalesce(nullif(o_orderstatus, 'P'), 'none')"),
    ("clip", "f", lambda f: f[P].clip(100000, 300000), f"greatest(100000, least(300000, {P}))"),
    ("where", "f", lambda f: f[P].where(f[K] > 500, 0.0), f"CASE WHEN {K} > 500 THEN {P} ELSE 0 END"),
    ("mask", "f", lambda f: f[P].mask(f[K] > 500), f"CASE WHEN {K} > 500 THEN NULL ELSE {P} END"),
    ("case_when", "s", lambda f: f["o_orderstatus"].case_when([(f[P] > 400000, "big"), (f[P] < 50000, "small")]), f"CASE WHEN {P} > 400000 THEN 'big' WHEN {P} < 50000 THEN 'small' ELSE o_orderstatus END"),
    ("cut", "s", lambda f: f[P].cut([0, 100000, 300000, 1000000], ["low", "mid", "high"]), f"CASE WHEN {P} > 0 AND {P} <= 100000 THEN 'low' WHEN {P} > 100000 AND {P} <= 300000 THEN 'mid' WHEN {P} > 300000 AND {P} <= 1000000 THEN 'high' END"),
    ("replace", "s", lambda f: f["o_orderstatus"].replace({"F": "done", "O": "open"}), "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END"),
    ("map_dict", "s", lambda f: f["o_orderstatus"].map({"F": "done", "O": "open"}), "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END"),
    ("map_function", "f", lambda f: f[P].map(lambda c: F.sqrt(c)), f"sqrt({P})"),
    ("astype", "i", lambda f: f[P].map(F.floor).astype("bigint"), f"floor({P})"),
    ("to_numeric_coerce", "f", lambda f: f["o_orderpriority"].str.slice(0, 1).to_numeric("coerce"), "TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)"),
]:
    column(f"elementwise_{name}", "orders", kind, make, sql)

# ---- array functions of numpy's names, element by element (events.value)
for name, make, sql in [
    ("sqrt", F.sqrt, "sqrt(abs({}))"), ("cbrt", F.cbrt, "cbrt({})"), ("square", lambda c: c * c, "{} * {}"), ("exp", lambda c: F.exp(c / 100), "exp({} / 100)"),
    ("expm1", lambda c: F.expm1(c / 1000), "exp({} / 1000) - 1"), ("log", lambda c: F.log(c + 1), "ln({} + 1)"), ("log2", lambda c: F.log2(c + 1), "log2({} + 1)"), ("log10", lambda c: F.log10(c + 1), "log10({} + 1)"), ("log1p", F.log1p, "ln(1 + {})"),
    ("sin", F.sin, "sin({})"), ("cos", F.cos, "cos({})"), ("tan", lambda c: F.tan(c / 1000), "tan({} / 1000)"), ("arcsin", lambda c: F.asin(c / 10000), "asin({} / 10000)"), ("arccos", lambda c: F.acos(c / 10000), "acos({} / 10000)"), ("arctan", F.atan, "atan({})"),
    ("sinh", lambda c: F.sinh(c / 1000), "sinh({} / 1000)"), ("cosh", lambda c: F.cosh(c / 1000), "cosh({} / 1000)"), ("tanh", lambda c: F.tanh(c / 100), "tanh({} / 100)"), ("arcsinh", F.asinh, "asinh({})"), ("arctanh", lambda c: F.atanh(c / 10000), "atanh({} / 10000)"),
    ("arctan2", lambda c: F.atan2(c, F.lit(3.0)), "atan2({}, 3.0)"), ("hypot", lambda c: F.hypot(c, F.lit(3.0)), "sqrt({} * {} + 9)"), ("degrees", F.degrees, "degrees({})"), ("radians", F.radians, "radians({})"),
    ("floor", F.floor, "floor({})"), ("ceil", F.ceil, "ceil({})"), ("trunc", lambda c: F.signum(c) * F.floor(F.abs(c)), "trunc({})"), ("rint", F.rint, "round_even({}, 0)"), ("sign", F.signum, "sign({})"), ("reciprocal", lambda c: F.try_divide(F.lit(1.0), c + 1), "1 / ({} + 1)"),
    ("maximum", lambda c: F.greatest(c, F.lit(20.0)), "greatest({}, 20.0)"), ("minimum", lambda c: F.least(c, F.lit(20.0)), "least({}, 20.0)"), ("logaddexp", lambda c: F.log(F.exp(c / 100) + F.lit(1.0)), "ln(exp({} / 100) + 1)"), ("sinc", lambda c: F.when(c == 0, 1.0).otherwise(F.sin(c * 0.1) / (c * 0.1)), "CASE WHEN {} = 0 THEN 1 ELSE sin({} * 0.1) / ({} * 0.1) END"), ("heaviside", lambda c: F.when(c < 20, 0.0).when(c == 20, 0.5).otherwise(1.0), "CASE WHEN {} < 20 THEN 0 WHEN {} = 20 THEN 0.5 ELSE 1 END"),
]:
    column(f"array_{name}", "events", "f", lambda f, make=make: f["value"].map(make), sql.replace("{}", "value"))

# ---- strings
T, C = "p_name", "c_name"
for name, table, kind, make, sql in [
    ("lower", "customer", "s", lambda f: f[C].str.lower(), "lower(c_name)"),
    ("upper", "part", "s", lambda f: f[T].str.upper(), "upper(p_name)"),
    ("len", "documents", "i", lambda f: f["text"].str.len(), "length(text)"),
    ("capitalize", "part", "s", lambda f: f["p_type"].str.capitalize(), "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))"),
    ("title", "part", "s", lambda f: f[T].str.title(), "upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2))"),
    ("swapcase", "customer", "s", lambda f: f[C].str.swapcase(), "'cUSTOMER' || substr(c_name, 9)"),
    ("reverse", "customer", "s", lambda f: f[C].str.reverse(), "reverse(c_name)"),
    ("strip", "customer", "s", lambda f: f[C].str.strip("Cr0"), "trim(c_name, 'Cr0')"),
    ("lstrip", "customer", "s", lambda f: f[C].str.lstrip("Cus"), "ltrim(c_name, 'Cus')"),
    ("rstrip", "customer", "s", lambda f: f[C].str.rstrip("0"), "rtrim(c_name, '0')"),
    ("contains_regex", "documents", "b", lambda f: f["text"].str.contains(r"th[ae]nd"), "regexp_matches(text, 'th[ae]nd')"),
    ("contains_plain", "pages", "b", lambda f: f["html"].str.contains("<table", regex=False), "contains(html, '<table')"),
    ("match", "part", "b", lambda f: f[T].str.match("(red|blue)"), "regexp_matches(p_name, '^(red|blue)')"),
    ("fullmatch", "part", "b", lambda f: f["p_brand"].str.fullmatch(r"Brand#\d"), "regexp_full_match(p_brand, 'Brand#[0-9]')"),
    ("startswith", "part", "b", lambda f: f[T].str.startswith("red"), "starts_with(p_name, 'red')"),
    ("endswith", "part", "b", lambda f: f[T].str.endswith("ring"), "ends_with(p_name, 'ring')"),
    ("find", "pages", "i", lambda f: f["url"].str.find("example"), "instr(url, 'example') - 1"),
    ("rfind", "customer", "i", lambda f: f[C].str.rfind("0"), "CASE WHEN instr(reverse(c_name), '0') = 0 THEN -1 ELSE length(c_name) - instr(reverse(c_name), '0') END"),
    ("count", "documents", "i", lambda f: f["text"].str.count("the"), "len(regexp_extract_all(text, 'the'))"),
    ("replace_plain", "customer", "s", lambda f: f[C].str.replace("#", "-"), "replace(c_name, '#', '-')"),
    ("replace_regex", "customer", "s", lambda f: f[C].str.replace("0+", "0", regex=True), "regexp_replace(c_name, '0+', '0', 'g')"),
    ("slice", "customer", "s", lambda f: f[C].str.slice(2, -3), "substr(c_name, 3, length(c_name) - 5)"),
    ("slice_tail", "customer", "s", lambda f: f[C].str.slice(-4), "right(c_name, 4)"),
    ("get", "customer", "s", lambda f: f[C].str.get(-1), "right(c_name, 1)"),
    ("pad_both", "part", "s", lambda f: f["p_type"].str.center(12, "*"), "repeat('*', ((12 - length(p_type)) // 2)::INT) || p_type || repeat('*', ((13 - length(p_type)) // 2)::INT)"),
    ("ljust", "part", "s", lambda f: f["p_type"].str.ljust(12, "-"), "rpad(p_type, greatest(12, length(p_type))::INT, '-')"),
    ("rjust", "part", "s", lambda f: f["p_type"].str.rjust(12, "-"), "lpad(p_type, greatest(12, length(p_type))::INT, '-')"),
    ("zfill", "part", "s", lambda f: f["p_size"].astype("string").str.zfill(4), "lpad(CAST(p_size AS VARCHAR), 4, '0')"),
    ("repeat", "part", "s", lambda f: f["p_type"].str.repeat(2), "repeat(p_type, 2)"),
    ("removeprefix", "part", "s", lambda f: f["p_brand"].str.removeprefix("Brand#"), "replace(p_brand, 'Brand#', '')"),
    ("removesuffix", "part", "s", lambda f: f[T].str.removesuffix(" ring"), "regexp_replace(p_name, ' ring$', '')"),
    ("split", "part", "s", lambda f: f[T].str.split(" ").list[1], "split_part(p_name, ' ', 2)"),
    ("split_words", "documents", "i", lambda f: f["text"].str.split().map(F.size), "len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+'))"),
    ("rsplit", "pages", "s", lambda f: f["url"].str.rsplit("/", 1).list[-1], "split_part(url, '/', -1)"),
    ("partition", "customer", "s", lambda f: f[C].str.partition("#").list[2], "split_part(c_name, '#', 2)"),
    ("extract", "customer", "s", lambda f: f[C].str.extract(r"#0*([1-9]\d*)"), "nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)', 1), '')"),
    ("findall", "customer", "s", lambda f: f[C].str.findall("[1-9]").map(lambda c: F.array_join(c, "|")), "array_to_string(regexp_extract_all(c_name, '[1-9]'), '|')"),
    ("cat", "part", "s", lambda f: f["p_brand"].str.cat(f["p_type"], sep="/"), "p_brand || '/' || p_type"),
    ("translate", "customer", "s", lambda f: f[C].str.translate("019", "abc"), "translate(c_name, '019', 'abc')"),
    ("encode_decode", "customer", "s", lambda f: f[C].str.encode().str.decode(), "decode(encode(c_name))"),
    ("isalnum", "part", "b", lambda f: f["p_brand"].str.isalnum(), "regexp_full_match(p_brand, '[\\p{L}\\p{N}]+')"),
    ("isalpha", "part", "b", lambda f: f["p_type"].str.isalpha(), "regexp_full_match(p_type, '\\p{L}+')"),
    ("isdigit", "customer", "b", lambda f: f[C].str.slice(9).str.isdigit(), "regexp_full_match(substr(c_name, 10), '[0-9]+')"),
    ("isspace", "part", "b", lambda f: f[T].str.slice(3, 4).str.isspace(), "substr(p_name, 4, 1) = ' '"),
    ("islower", "part", "b", lambda f: f[T].str.islower(), "p_name = lower(p_name)"),
    ("isupper", "part", "b", lambda f: f["p_type"].str.isupper(), "p_type = upper(p_type)"),
    ("istitle", "customer", "b", lambda f: f[C].str.istitle(), "true"),
    ("join_chars", "part", "s", lambda f: f["p_type"].str.join("."), "array_to_string(string_split(p_type, ''), '.')"),
    ("normalize_space", "documents", "s", lambda f: f["text"].str.normalize_space(), "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"),
]:
    column(f"str_{name}", table, kind, make, sql)

# ---- dates and times (events.ts, orders.o_orderdate)
D, E = "o_orderdate", "ts"
for name, table, kind, make, sql in [
    ("year", "orders", "i", lambda f: f[D].dt.year(), "year(o_orderdate)"), ("month", "orders", "i", lambda f: f[D].dt.month(), "month(o_orderdate)"), ("day", "orders", "i", lambda f: f[D].dt.day(), "day(o_orderdate)"),
    ("hour", "events", "i", lambda f: f[E].dt.hour(), "hour(ts)"), ("minute", "events", "i", lambda f: f[E].dt.minute(), "minute(ts)"), ("second", "events", "i", lambda f: f[E].dt.second(), "extract(second FROM ts)"),
    ("microsecond", "events", "i", lambda f: f[E].dt.microsecond(), "extract(microsecond FROM ts) % 1000000"), ("nanosecond", "events", "i", lambda f: f[E].dt.nanosecond(), "0"),
    ("quarter", "orders", "i", lambda f: f[D].dt.quarter(), "quarter(o_orderdate)"), ("dayofweek", "orders", "i", lambda f: f[D].dt.dayofweek(), "isodow(o_orderdate) - 1"), ("dayofyear", "orders", "i", lambda f: f[D].dt.dayofyear(), "dayofyear(o_orderdate)"), ("weekofyear", "orders", "i", lambda f: f[D].dt.weekofyear(), "weekofyear(o_orderdate)"),
    ("days_in_month", "orders", "i", lambda f: f[D].dt.days_in_month(), "day(last_day(o_orderdate))"), ("day_name", "orders", "s", lambda f: f[D].dt.day_name(), "dayname(o_orderdate)"), ("month_name", "orders", "s", lambda f: f[D].dt.month_name(), "monthname(o_orderdate)"),
    ("date", "events", "d", lambda f: f[E].dt.date(), "CAST(ts AS DATE)"), ("time", "events", "s", lambda f: f[E].dt.time(), "strftime(ts, '%H:%M:%S.%f')"), ("normalize", "events", "t", lambda f: f[E].dt.normalize(), "date_trunc('day', ts)"),
    ("is_leap_year", "orders", "b", lambda f: f[D].dt.is_leap_year(), "(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0"),
    ("is_month_start", "orders", "b", lambda f: f[D].dt.is_month_start(), "day(o_orderdate) = 1"), ("is_month_end", "orders", "b", lambda f: f[D].dt.is_month_end(), "CAST(o_orderdate AS DATE) = last_day(o_orderdate)"),
    ("is_quarter_start", "orders", "b", lambda f: f[D].dt.is_quarter_start(), "day(o_orderdate) = 1 AND month(o_orderdate) IN (1, 4, 7, 10)"), ("is_quarter_end", "orders", "b", lambda f: f[D].dt.is_quarter_end(), "CAST(o_orderdate AS DATE) = last_day(o_orderdate) AND month(o_orderdate) IN (3, 6, 9, 12)"),
    ("is_year_start", "orders", "b", lambda f: f[D].dt.is_year_start(), "dayofyear(o_orderdate) = 1"), ("is_year_end", "orders", "b", lambda f: f[D].dt.is_year_end(), "month(o_orderdate) = 12 AND day(o_orderdate) = 31"),
    ("strftime", "events", "s", lambda f: f[E].dt.strftime("%Y/%m/%d %H-%M"), "strftime(ts, '%Y/%m/%d %H-%M')"),
    ("floor", "events", "t", lambda f: f[E].dt.floor("h"), "date_trunc('hour', ts)"), ("ceil", "events", "t", lambda f: f[E].dt.ceil("h"), "CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END"), ("round", "events", "t", lambda f: f[E].dt.round("min"), "CASE WHEN ts - date_trunc('minute', ts) > INTERVAL 30 SECOND THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE ELSE date_trunc('minute', ts) END"),
    ("to_period", "orders", "s", lambda f: f[D].dt.to_period("M"), "strftime(o_orderdate, '%Y-%m')"), ("tz_convert", "events", "t", lambda f: f[E].dt.tz_convert("+02:00"), "ts + INTERVAL 2 HOUR"), ("tz_localize", "events", "t", lambda f: f[E].dt.tz_localize("+02:00"), "ts - INTERVAL 2 HOUR"), ("epoch", "events", "f", lambda f: f[E].dt.epoch(), "epoch_us(ts) / 1000000.0"),
    ("total_seconds", "events", "f", lambda f: f[E].dt.total_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0"),
    ("to_datetime_format", "orders", "t", lambda f: f[D].dt.strftime("%d.%m.%Y").map(lambda c: to_datetime(c, "%d.%m.%Y")), "strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')"), ("to_datetime_unit", "orders", "t", lambda f: f["o_orderkey"].map(lambda c: to_datetime(c, unit="s")), "make_timestamp(o_orderkey * 1000000)"), ("to_datetime_coerce", "orders", "t", lambda f: f["o_orderpriority"].map(lambda c: to_datetime(c, "%Y-%m-%d", errors="coerce")), "NULL"),
]:
    column(f"dt_{name}", table, kind, make, sql)

# ---- maps, arrays, structs, JSON, key-value text
_map = lambda c: F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), F.col("p_partkey").cast("int"))
_list = lambda c: F.array(F.col("p_size"), F.col("p_partkey").cast("int"), F.lit(7))
_struct = lambda c: F.struct(F.col("p_type").alias("kind"), F.struct(F.col("p_size").alias("size")).alias("in"))
for name, table, kind, make, sql in [
    ("dict_getitem", "part", "i", lambda f: f["p_size"].map(_map).dict["size"], "p_size"), ("dict_missing", "part", "i", lambda f: f["p_size"].map(_map).dict["none"], "NULL"), ("dict_get_default", "part", "i", lambda f: f["p_size"].map(_map).dict.get("none", -1), "-1"), ("dict_contains", "part", "b", lambda f: f["p_size"].map(_map).dict.contains("key"), "true"), ("dict_len", "part", "i", lambda f: f["p_size"].map(_map).dict.len(), "2"),
    ("dict_remove", "part", "i", lambda f: f["p_size"].map(_map).dict.remove("key").dict.len(), "1"), ("dict_setitem", "part", "i", lambda f: f["p_size"].map(_map).dict.set("size", 99).dict["size"], "99"),
    ("list_getitem", "part", "i", lambda f: f["p_size"].map(_list).list[1], "p_partkey"), ("list_last", "part", "i", lambda f: f["p_size"].map(_list).list[-1], "7"), ("list_out_of_range", "part", "i", lambda f: f["p_size"].map(_list).list[9], "NULL"), ("list_len", "embeddings", "i", lambda f: f["embedding"].list.len(), "len(embedding)"),
    ("struct_field", "part", "s", lambda f: f["p_type"].map(_struct).struct.field("kind"), "p_type"), ("struct_nested", "part", "i", lambda f: f["p_type"].map(_struct).struct.field("in", "size"), "p_size"),
    ("flatjson", "events", "i", lambda f: f["props"].map(lambda c: flatjson(c, {"k": "$.k"}, {"k": "bigint"})[0]), "CAST(json_extract(props, '$.k') AS BIGINT)"), ("flatjson_missing", "events", "s", lambda f: f["props"].map(lambda c: flatjson(c, {"z": "$.z"})[0]), "json_extract_string(props, '$.z')"),
    ("collect_kv", "part", "s", lambda f: f["p_size"].map(lambda c: collect_kv({"size": c, "type": F.col("p_type")})), "'size=' || p_size || ',type=' || p_type"), ("extract_kv", "part", "s", lambda f: f["p_size"].map(lambda c: extract_kv(collect_kv({"size": c, "type": F.col("p_type")}), ["type"])[0]), "p_type"),
    ("list_norm", "embeddings", "f", lambda f: f["embedding"].map(lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), "sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))"),
]:
    column(f"nested_{name}", table, kind, make, sql)
