"""One spelling for keys, volumes, digests and words, as column expressions and as the same SQL text.

Every function maps NULL to NULL. The ``sql_*`` twins give DuckDB text for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decoded_key(c: Column | str) -> Column:
    """Percent-decode once. ``%`` without two hex digits stays, ``+`` stays.

    A key whose escapes do not form UTF-8 stays as it stands, so that no two of them are merged.
    """
    c = _col(c)
    guarded = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    plain = F.try_url_decode(guarded)
    broken = F.contains(plain, F.lit("�")) & ~F.contains(F.lower(c), F.lit("%ef%bf%bd")) & ~F.contains(c, F.lit("�"))
    return F.when(F.contains(c, F.lit("%")), F.when(broken, c).otherwise(F.coalesce(plain, c))).otherwise(c)


def word(c: Column | str) -> Column:
    """Trimmed, lower case: operations, events, actors, states."""
    return F.lower(F.trim(_col(c), F.lit(BLANKS)))


volume = word


def digest(c: Column | str) -> Column:
    """A BLAKE3 text in lower case without a leading ``blake3:``."""
    return F.regexp_replace(F.lower(_col(c)), "^blake3:", "")


def log_op(c: Column | str) -> Column:
    """A log operation; ``del`` means delete, the byte codes 1 and 2 mean put and delete."""
    w = word(c)
    return F.when(w.isin("del", "2"), "delete").when(w == "1", "put").otherwise(w)


def month_of_millis(c: Column | str) -> Column:
    """``YYYY-MM`` in UTC of Unix milliseconds, whatever the session's zone; NULL beyond the calendar."""
    days = F.floor(_col(c) / F.lit(86_400_000)).try_cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def sql_key(c: str) -> str:
    return f"url_decode({c})"


def sql_word(c: str) -> str:
    return f"lower(trim({c}))"


def sql_digest(c: str) -> str:
    return f"regexp_replace(lower({c}), '^blake3:', '')"


def sql_op(c: str) -> str:
    return f"case lower(trim({c})) when 'del' then 'delete' when '2' then 'delete' when '1' then 'put' else lower(trim({c})) end"


def sql_month(c: str) -> str:
    return f"strftime(make_timestamp({c} * 1000), '%Y-%m')"
