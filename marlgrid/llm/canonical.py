"""Map freely typed values to the closest entry of a reference list.

Values are first made distinct (with their context, here the state), so a value
that a third of all rows share is matched once.  Each is brought to one form
(see ``unify``), folded, stripped of additions such as a state code or "(centro)"
and of filler words, and its abbreviations are written out.  Character 2-grams of
that form look up an inverted index of the reference, the rarest first and as many
as no allowed number of edits can destroy; candidates are scored by idf-weighted
cosine and confirmed by edit distance with transpositions.  A value is accepted if
its distance is within a bound that depends on its length and its lead over the next
different name is large enough; otherwise it is reported as unmatched.

Among entries of one name, an entry of the value's own context wins, then the
current over a former name, then the smallest id.

Everything is equi-joins of distinct values and names, by form or by gram: neither
side has to fit a task, nothing is broadcast but counts, and no candidate is cut.
Null and blank values give no row.  An empty reference leaves every value unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.llm.unify import unify
from marlgrid.session import cut


@dataclass(frozen=True)
class Habits:
    """How people write the values of a domain."""

    #: Written-out forms of abbreviations (as the first word, or as any other).
    first: dict[str, str] = field(default_factory=dict)
    other: dict[str, str] = field(default_factory=dict)
    #: Words that carry no meaning and are often left out or glued on.
    fillers: frozenset[str] = frozenset()
    #: Patterns of additions before and after the value.
    before: str = ""
    after: str = ""


# Habits of writing Portuguese place names.
PLACES = Habits(
    first={"sta": "santa", "sto": "santo", "s": "sao", "n": "nova", "b": "barra", "pto": "porto", "lg": "lagoa", "mte": "monte", "cpo": "campo", "vl": "vila"},
    other={"nte": "norte"},
    fillers=frozenset({"de", "da", "do", "das", "dos", "d"}),
    before=r"(?:mun\.?|municipio(?: de)?|cidade(?: de)?) +",
    after=r"(?:, *br|,? +brasil|\(centro\))",
)


def fold(text: str) -> str:
    """One form, case-folded, without accents, single spaces."""
    plain = unicodedata.normalize("NFD", unify(text).casefold())
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def core(folded: str, habits: Habits, contexts: frozenset[str]) -> str:
    """What of a folded value is compared: letters and digits of its meaningful words."""
    value = folded
    while True:
        shorter = re.sub(rf"^{habits.before}", "", value) if habits.before else value
        shorter = re.sub(rf" *{habits.after}$", "", shorter) if habits.after else shorter
        tail = re.search(r" *(?:[,/(]| ?-) *([a-z]{2,3})\)?$", shorter)
        if tail and tail.group(1) in contexts and tail.start():
            shorter = shorter[: tail.start()]
        if shorter == value or not shorter:
            break
        value = shorter
    words = re.findall(r"\w+", value)
    kept = []
    for i, w in enumerate(words):
        w = habits.first.get(w, w) if i == 0 and len(words) > 1 else habits.other.get(w, w)
        if w not in habits.fillers or i == 0:
            kept.append(w)
    return "".join(kept)


def glued(folded: str, habits: Habits) -> str:
    """Letters and digits with the fillers kept, for values typed without spaces."""
    return re.sub(r"\W+", "", re.sub(rf"^{habits.before}", "", folded) if habits.before else folded)


def distance(a: str, b: str) -> int:
    """Edits, swaps of neighbours included, between two strings (bit-parallel)."""
    if not a or not b:
        return len(a) or len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    up, down, diagonal, before, edits = full, 0, 0, 0, len(a)
    for ch in b:
        here = at.get(ch, 0)
        swap = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swap) & full
        right_up = (down | ~(diagonal | up)) & full
        right_down = diagonal & up
        edits += bool(right_up & top) - bool(right_down & top)
        shifted = (right_up << 1 | 1) & full
        up = ((right_down << 1) | ~(diagonal | shifted)) & full
        down = diagonal & shifted
        before = here
    return edits


def allowed_edits(length: Column) -> Column:
    """Edits that a value of that many letters may have: 1 up to 4 letters, 2 up to 9, then 3."""
    return F.when(length <= 4, 1).when(length <= 9, 2).otherwise(3)


MOST_ALLOWED = 3
#: 2-grams that one edit, a swap of neighbours included, can destroy.
DESTROYED = 3


def grams(text: Column) -> Column:
    """Distinct character 2-grams, the ends marked."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(2))))


def _shapes(texts: DataFrame, column: str, habits: Habits, contexts: frozenset[str]) -> DataFrame:
    """Adds ``form`` and ``whole`` of a text column."""

    @F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("whole", T.StringType())]))
    def shaped(values: pd.Series) -> pd.DataFrame:
        folded = [fold(v) for v in values]
        return pd.DataFrame({"form": [core(f, habits, contexts) for f in folded], "whole": [glued(f, habits) for f in folded]})

    return texts.withColumn("_s", shaped(F.col(column))).select(*texts.columns, F.col("_s.form").alias("form"), F.col("_s.whole").alias("whole"))


@F.pandas_udf(T.IntegerType())
def _fewest_edits(form: pd.Series, whole: pd.Series, name_form: pd.Series, name_whole: pd.Series) -> pd.Series:
    # A misspelt filler word is an edit like any other: the form with fillers counts too.
    return pd.Series([min(distance(f, n), distance(w, m)) for f, w, n, m in zip(form, whole, name_form, name_whole)], dtype="int32")


def _texts(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """A row per different text of a name or value (its form, its whole), with what it stands for."""
    one = F.struct(F.col("form").alias("text"), F.lit(True).alias("is_form"), (F.col("form") == F.col("whole")).alias("is_whole"))
    two = F.struct(F.col("whole").alias("text"), F.lit(False).alias("is_form"), F.lit(True).alias("is_whole"))
    return df.select(*[F.col(c).alias(name) for c, name in keep.items()], F.explode(F.when(F.col("form") == F.col("whole"), F.array(one)).otherwise(F.array(one, two))).alias("t")).select(*keep.values(), "t.*")


def candidates(asked: DataFrame, names: DataFrame, beyond: int = 0) -> DataFrame:
    """(form, whole, name_form, edits, cosine): every name within the edits that a value may have, and ``beyond``.

    ``asked`` and ``names`` have form and whole, each form of ``names`` once.  One
    edit destroys at most three 2-grams, so of a value's 3k+1 rarest ones at least
    one stands in every name within k edits: those look up the inverted index, an
    equi-join by gram that no cap cuts.  Length and a bounded Levenshtein distance
    thin the hits out before the exact distance is taken.
    """
    # The inverted index: gram -> names, and in how many names a gram stands.
    posted = _texts(names, {"form": "name_form", "whole": "name_whole"}).select("*", F.explode(grams(F.col("text"))).alias("gram"))
    spread = posted.where("is_form").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    count = names.agg(F.count(F.lit(1)).alias("all_names"))

    probed = _texts(asked, {"form": "form", "whole": "whole"}).select("*", (allowed_edits(F.length("form")) + beyond).alias("k"), F.explode(grams(F.col("text"))).alias("gram"))
    weighed = probed.join(spread.select(F.col("gram").alias("known_gram"), "n"), F.col("gram") == F.col("known_gram"), "left").select("form", "whole", "text", "is_form", "is_whole", "k", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    sorted_ = weighed.groupBy("form", "whole", "text", "is_form", "is_whole", "k").agg(F.array_sort(F.collect_list("g")).alias("gs"))  # as many as the text has letters
    rarest = sorted_.select("form", "whole", "text", F.col("is_form").alias("f"), F.col("is_whole").alias("w"), "k", F.explode(F.filter(F.slice("gs", F.lit(1), DESTROYED * F.col("k") + 1), lambda g: g["n"] > 0)).alias("g"))
    hits = rarest.select("form", "whole", F.col("text").alias("mine"), "f", "w", "k", F.col("g.gram").alias("wanted")).join(
        posted,
        (F.col("wanted") == F.col("gram")) & ((F.col("f") & F.col("is_form")) | (F.col("w") & F.col("is_whole"))) & (F.abs(F.length("mine") - F.length("text")) <= F.col("k")),
    )
    # A swap counts as two for Levenshtein: within twice the edits lies all that is wanted.
    close = hits.where(F.expr("levenshtein(mine, text, 2 * k)") >= 0).select("form", "whole", "k", "name_form", "name_whole").distinct()
    near = close.withColumn("edits", _fewest_edits("form", "whole", "name_form", "name_whole")).where(F.col("edits") <= F.col("k"))

    # Idf-weighted cosine of the forms' grams, for what is left.
    def idf(n: Column) -> Column:
        return F.log(1 + F.col("all_names") / n)

    square = lambda gs: F.aggregate(gs, F.lit(0.0), lambda a, g: a + g["w"] * g["w"])
    vectors = sorted_.where("is_form").crossJoin(F.broadcast(count)).select(F.col("form").alias("v_form"), F.col("whole").alias("v_whole"), F.transform("gs", lambda g: F.struct(g["gram"].alias("gram"), idf(F.greatest(g["n"], F.lit(0.5))).alias("w"))).alias("v"))
    norms = posted.where("is_form").join(spread.select(F.col("gram").alias("known_gram"), "n"), F.col("gram") == F.col("known_gram")).crossJoin(F.broadcast(count)).groupBy(F.col("name_form").alias("n_form")).agg(F.sqrt(F.sum(idf(F.col("n")) * idf(F.col("n")))).alias("norm"))
    scored = near.join(vectors, (F.col("form") == F.col("v_form")) & (F.col("whole") == F.col("v_whole"))).join(norms, F.col("name_form") == F.col("n_form"))
    shared = F.filter("v", lambda g: F.array_contains(grams(F.col("name_form")), g["gram"]))
    return scored.select("form", "whole", "name_form", "edits", (square(shared) / (F.sqrt(square(F.col("v"))) * F.col("norm"))).alias("cosine"))


def match_values(values: DataFrame, reference: DataFrame, *, habits: Habits = PLACES, margin: int = 1) -> DataFrame:
    """(value, context, entry_id, edits, cosine) of distinct (value, context) rows.

    ``values`` has string columns value and context; ``reference`` has
    entry_id (bigint), name, context and former (whether the name is a former
    one).  ``entry_id`` is null for values without an entry.  ``margin`` is by
    how many edits the best name must lead over the next different one.
    """
    entries = reference.select(F.col("entry_id").cast("bigint").alias("entry"), F.col("name").cast("string").alias("text"), F.upper("context").alias("place"), F.col("former").cast("boolean").alias("former")).where("text IS NOT NULL AND entry IS NOT NULL")
    # Codes of two or three letters, which may stand behind a value: 18,252 at the very most.
    contexts = frozenset(r[0] for r in entries.select(F.lower("place").alias("c")).where(F.col("c").rlike("^[a-z]{2,3}$")).distinct().collect())
    entries = cut(_shapes(entries, "text", habits, contexts).where("form != ''"))
    given = values.select(F.col("value").cast("string").alias("value"), F.upper(F.col("context").cast("string")).alias("context")).where("value IS NOT NULL").distinct()
    known = cut(_shapes(given, "value", habits, contexts))

    names = entries.groupBy("form").agg(F.min("whole").alias("whole"))
    spelled = entries.groupBy("whole").agg(F.min("form").alias("form"))
    asked = known.select("form", "whole").distinct()
    same = asked.join(names.select(F.col("form").alias("name_form")), F.col("form") == F.col("name_form"), "left").join(spelled.select(F.col("whole").alias("its_whole"), F.col("form").alias("its_form")), F.col("whole") == F.col("its_whole"), "left")
    same = cut(same.select("form", "whole", F.coalesce("name_form", "its_form").alias("name_form")))
    exact = same.where("name_form IS NOT NULL").select("form", "whole", "name_form", F.lit(0).alias("edits"), F.lit(1.0).alias("cosine"))

    found = candidates(same.where("name_form IS NULL AND form != ''").select("form", "whole"), names, margin - 1)
    most = MOST_ALLOWED + margin
    best = found.groupBy("form", "whole").agg(F.min(F.struct("edits", (-F.col("cosine")).alias("far"), "name_form")).alias("best"), F.array(*[F.count_if(F.col("edits") == e) for e in range(most)]).alias("at"))
    rivals = F.aggregate(F.slice("at", F.col("best.edits") + 1, F.lit(margin)), F.lit(0).cast("bigint"), lambda a, x: a + x) - 1
    best = best.where((F.col("best.edits") <= allowed_edits(F.length("form"))) & (rivals == 0)).select("form", "whole", F.col("best.name_form").alias("name_form"), F.col("best.edits").alias("edits"), (-F.col("best.far")).alias("cosine"))

    # Among entries of one name: the value's context, then the current name, then the smallest id.
    chosen = exact.unionAll(best)
    meant = known.join(chosen, ["form", "whole"]).join(entries.select(F.col("form").alias("name_form"), "entry", "place", "former"), "name_form")
    order = F.struct(~F.coalesce(F.col("place") == F.col("context"), F.lit(False)), "former", "entry")
    picked = meant.groupBy("value", "context").agg(F.min_by("entry", order).alias("entry_id"), F.min("edits").alias("edits"), F.min("cosine").alias("cosine"))
    picked = picked.select(F.col("value").alias("v"), F.col("context").alias("c"), "entry_id", "edits", "cosine")
    return known.join(picked, (F.col("value") == F.col("v")) & F.col("context").eqNullSafe(F.col("c")), "left").select("value", "context", "entry_id", "edits", "cosine")
