"""Problem 4: several values packed in one field, split by delimiter skeletons.

A field is cut at its outer ``;`` into attributes and these at their outer ``,`` and ``|`` into values, each with the
head of its attribute before it. The skeleton of such a piece is what is left when ordinary characters are masked: a
tag, and a value or the content of its quotes, become one ``x``, a run of blanks one blank; ``;``, ``=`` and enclosing
quotes stay. So there are no more than 48 skeletons, whatever the data. The grammar is resolved once for each, into
a rule that names the places of the tag and of the value among the piece's tokens; the rules are broadcast, and the
pieces are cut into tokens and picked from by place, inside the JVM and without a shuffle.

Grammar: attributes are separated by ``;``; the tag ends at the first blank or ``=``; blanks and at most one ``=`` part
it from its values; values are separated by ``,`` or ``|``; a value that begins with a quote runs to the same closing
quote (a doubled double quote is one quote inside) and loses its quotes; ``%`` and two hex digits are decoded.

Defined results: null, empty and ``.`` fields, attributes without a value and empty values give nothing; a quote that
is never closed, or whose closing quote is followed by more text, is ordinary text of the value and is kept; a null id
is kept; repeated rows give their values again; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = "[ \\t]*+[^ \\t=;]*+[ \\t]*+=?+"
_VALUE = """[ \\t]*+(?:"[^"]*+(?:""[^"]*+)*+"[^,|;]*+|'[^']*+'[^,|;]*+|[^,|;]*+)"""
_ATTRIBUTE = f";{_HEAD}{_VALUE}(?:[,|]{_VALUE})*+"
_DOUBLE, _SINGLE = '^"[^"]*+(?:""[^"]*+)*+"$', "^'[^']*+'$"


def resolve(sk: str) -> list[tuple[int, int, int, int, bool]]:
    """(first token of the tag, how many, first token of the value, how many, double quoted) for each value of a skeleton."""
    out, i, n = [], 0, len(sk)

    def blanks(i: int) -> int:
        while i < n and sk[i] in " \t":
            i += 1
        return i

    while i < n:
        i = blanks(i)
        if i < n and sk[i] == ";":
            i += 1
            continue
        t = i
        while i < n and sk[i] not in " \t=;":
            i += 1
        tag = (t, i - t)
        i = blanks(i)
        if i < n and sk[i] == "=":
            i = blanks(i + 1)
        while i < n and sk[i] != ";":
            i = blanks(i)
            a, close = i, -1
            if i < n and sk[i] in "\"'":
                close = _closing(sk, i)
            j = close + 1 if close >= 0 else i
            if close < 0 and i < n and sk[i] in "\"'":
                j = i + 1
            while j < n and sk[j] not in ",|;":
                j += 1
            b = j
            while b > a and sk[b - 1] in " \t":
                b -= 1
            if close >= 0 and b == close + 1:
                if b - a > 2:
                    out.append((*tag, a + 1, b - a - 2, sk[a] == '"'))
            elif b > a:
                out.append((*tag, a, b - a, False))
            i = j
            if i < n and sk[i] in ",|":
                i += 1
    return out


def _closing(sk: str, i: int) -> int:
    q, j, n = sk[i], i + 1, len(sk)
    while j < n:
        if sk[j] == q:
            if q == '"' and j + 1 < n and sk[j + 1] == '"':
                j += 2
                continue
            return j
        j += 1
    return -1


def skeletons() -> list[str]:
    """All skeletons of a piece: blanks, tag, blanks and ``=``, each there or not, before a value in either quotes or in none."""
    return [";" + "".join(p) for p in product(("", " "), ("", "x"), ("", " "), ("", "="), ("x", '"x"', "'x'"))]


def rule_table(spark) -> DataFrame:
    """(sk, tf, tl, vf, vl, q): the rule of each skeleton that has a value."""
    found = {sk: resolve(sk) for sk in skeletons()}
    return spark.createDataFrame([(sk, *r[0]) for sk, r in found.items() if r], "sk string, tf int, tl int, vf int, vl int, q boolean")


def percent_decode(c: Column) -> Column:
    """``%`` and two hex digits become their character (as UTF-8); any other ``%`` and ``+`` stay."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(c, F.lit("%")), F.url_decode(safe)).otherwise(c)


def _pieces(field: Column) -> Column:
    """Array of (head, val): every value that is not empty, without the blanks around it, with the head of its attribute."""
    blanks = F.lit(" \t")

    def values(a: Column) -> Column:
        found = F.transform(F.regexp_extract_all(a, F.lit(f"(?:^;{_HEAD}|[,|])({_VALUE})"), F.lit(1)), lambda v: F.btrim(v, blanks))
        head = F.regexp_extract(a, f"^;{_HEAD}", 0)
        return F.transform(F.filter(found, lambda v: ~v.isin("", '""', "''")), lambda v: F.struct(head.alias("head"), v.alias("val")))

    return F.flatten(F.transform(F.regexp_extract_all(F.concat(F.lit(";"), field), F.lit(_ATTRIBUTE), F.lit(0)), values))


def split_packed(df: DataFrame, id_col: str, field_col: str) -> DataFrame:
    """(id, val_pos, tag, val): one row per value, numbered from 0 from left to right in its field."""
    rows = df.select(F.col(id_col).alias("id"), F.trim(F.col(field_col)).alias("field")).filter(F.col("field").isNotNull() & ~F.col("field").isin("", "."))
    rows = rows.select("id", F.posexplode(_pieces(F.col("field"))).alias("val_pos", "piece")).select("id", "val_pos", F.col("piece.head").alias("head"), F.col("piece.val").alias("val"))
    head, val = F.col("head"), F.col("val")
    # tokens and their mask: one symbol of the skeleton for each token
    quote = F.when(val.rlike(_DOUBLE), '"').when(val.rlike(_SINGLE), "'").otherwise("")
    rows = rows.withColumn("quote", F.when(F.left(val, F.lit(1)).isin('"', "'"), quote).otherwise(""))
    masked = F.regexp_replace(F.regexp_replace(head, "[^ \\t=;]+", "x"), "[ \\t]+", " ")
    sk = F.coalesce(F.concat(masked, F.col("quote"), F.lit("x"), F.col("quote")), F.lit(""))  # never null, so that no filter works it out before the join
    inner = F.when(F.col("quote") == "", F.array(val)).otherwise(F.array(F.col("quote"), F.substring(val, F.lit(2), F.length(val) - 2), F.col("quote")))
    tokens = F.concat(F.regexp_extract_all(head, F.lit("([^ \\t=;]+|[ \\t]+|[;=])"), F.lit(1)), inner)
    joined = rows.select("id", "val_pos", sk.alias("sk"), tokens.alias("tok")).join(F.broadcast(rule_table(df.sparkSession)), "sk")
    pick = lambda f, n: F.array_join(F.slice("tok", F.col(f) + 1, F.col(n)), "")
    value = F.when(F.col("q"), F.replace(pick("vf", "vl"), F.lit('""'), F.lit('"'))).otherwise(pick("vf", "vl"))
    return joined.select("id", "val_pos", pick("tf", "tl").alias("tag"), value.alias("val")).withColumn("val", percent_decode(F.col("val")))
