r"""Redaction of secrets, kind by kind in a fixed order.

The patterns are our own reading of the sixteen documented kinds; a token needs a body of at least
20 characters where a prefix marks it, so that a header with a short one counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
_Q = r"""(?:"[^"]*"|'[^']*'|[^\s"']+)"""

PATTERNS = (
    ("assignment", r"(?i)(?<![A-Za-z0-9])(?:password|passwd|token|api_?key|apikey|secret|credentials?)\s*=\s*" + _Q),
    ("export", r"(?i)(?<![A-Za-z0-9_])export\s+[A-Za-z0-9_]*(?:SECRET|TOKEN|KEY|PASSWORD|CREDENTIALS|AUTH)[A-Za-z0-9_]*=(?!\[REDACTED\])" + _Q),
    ("docker login", r"(?<![A-Za-z0-9_])docker\s+login[^\n]*"),
    ("ssh key", r"(?<![A-Za-z0-9_])ssh\s+-i\s+\S+"),
    ("ssh agent", r"(?<![A-Za-z0-9_])ssh-add\s+\S+"),
    ("url credentials", r"(?<=://)[^\s/:@]+:[^\s/@]+@"),
    ("curl auth", r"(?<=curl\s{1,4})(?:-u|--user)[\s=]+\S+|(?<![A-Za-z0-9_-])(?:-u|--user)[\s=]+[^\s:]+:\S+"),
    ("aws key", r"AKIA[0-9A-Z]{16}"),
    ("github token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("gitlab token", r"glpat-[A-Za-z0-9_-]{10,}"),
    ("npm token", r"npm_[A-Za-z0-9]{10,}"),
    ("npm config", r"(?<![A-Za-z0-9_])npm\s+config\s+set\s+\S*_(?:authToken|auth|password)\s+\S+"),
    ("bearer", r"(?i)(?:Authorization:\s*)?Bearer\s+[^\s\"'\[]+"),
    ("authorization", r"(?i)Authorization\s*[:=]\s*(?!\[REDACTED\])[^\s\"']+(?:\s+[^\s\"'-][^\s\"']*)?"),
    ("base64", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40,}={0,2}"),
    ("hex", r"(?<==)[\s\"']{0,2}[0-9a-fA-F]{32,}"),
)


#: What a text must hold for a kind to occur in it: groups of literals, of each of which one is needed.
#: Those in lower case count in either case.  ``RUN`` stands for a long run of letters, digits, + and /.
RUN = "\0run"
TRIGGERS = {
    "assignment": (("=",), ("password", "passwd", "token", "apikey", "api_key", "secret", "credential")),
    "export": (("=",), ("export",), ("secret", "token", "key", "password", "credentials", "auth")),
    "docker login": (("docker",), ("login",)),
    "ssh key": (("ssh",), ("-i",)),
    "ssh agent": (("ssh-add",),),
    "url credentials": (("://",), ("@",)),
    "curl auth": (("-u",),),
    "aws key": (("AKIA",),),
    "github token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),),
    "gitlab token": (("glpat-",),),
    "npm token": (("npm_",),),
    "npm config": (("npm",), ("config",), ("_auth", "_password")),
    "bearer": (("bearer",),),
    "authorization": (("authorization",),),
    "base64": ((RUN,),),
    "hex": (("=",),),
}
_LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"


def triggers(text: Column, low: Column | None = None) -> Column:
    """A bit for each kind: whether the text may hold one.

    A redaction leaves nothing from which a literal could arise, so the bits of the text at the start hold for
    all kinds in turn.
    """
    low = F.lower(text) if low is None else low

    def holds(literal: str) -> Column:
        if literal == RUN:
            return text.rlike(_LONG_RUN)
        return F.contains(text if literal != literal.lower() else low, F.lit(literal))

    bits = F.lit(0)
    for k, (kind, _) in enumerate(PATTERNS):
        needs = None
        for group in TRIGGERS[kind]:
            one = holds(group[0])
            for literal in group[1:]:
                one = one | holds(literal)
            needs = one if needs is None else needs & one
        bits = bits.bitwiseOR(F.when(needs, F.lit(1 << k)).otherwise(F.lit(0)))
    return bits


def scrub(text: Column) -> tuple[Column, Column]:
    """The redacted text and the number of redactions, as expressions: for a few values, such as patterns in prompts."""
    count = F.lit(0)
    for _, pattern in PATTERNS:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, r"\[REDACTED\]")
    return text, count


def scrub_column(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` redacted and redacted_count.

    One pass over the text finds which kinds may occur; only those are searched for.  Each kind is one projection.
    """
    # The lowered text is a column of its own, so that it is made once and not for each literal.
    out = df.withColumn("_low", F.lower(F.col(column))).withColumns({"_bits": F.coalesce(triggers(F.col(column), F.col("_low")), F.lit(0)), "_n": F.lit(0)}).drop("_low")
    for k, (_, pattern) in enumerate(PATTERNS):
        may = F.col("_bits").bitwiseAND(F.lit(1 << k)) != 0
        found = F.when(may, F.coalesce(F.regexp_count(F.col(column), F.lit(pattern)), F.lit(0))).otherwise(F.lit(0))
        out = out.withColumns({"_n": F.col("_n") + found, column: F.when(may, F.regexp_replace(F.col(column), pattern, r"\[REDACTED\]")).otherwise(F.col(column))})
    return out.drop("_bits").withColumnRenamed("_n", "redacted_count")


def scrub_patterns(patterns: DataFrame) -> DataFrame:
    """Redact pattern and each of variations."""
    one = lambda c: scrub(c)[0]
    return patterns.withColumn("pattern", one(F.col("pattern"))).withColumn("variations", F.transform("variations", one))
