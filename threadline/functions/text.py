"""Column functions that clean SQL text. All run in the JVM on whole texts.

Patterns avoid repeated groups over single characters unless they are possessive: Java's engine
evaluates others recursively, which overflows the stack on long texts.

What a text says is decided on tokens: string literals, quoted names and comments are matched as
wholes, in one pass from the left, so a mark within one of them never opens another.

Patterns begin with a look-ahead at the characters a match can start with. It finds nothing else, but
the engine passes over all other characters without trying word bounds and alternatives at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement keywords that always start a statement.
STATEMENT_KEYWORDS = "DECLARE|INSERT|UPDATE|DELETE|MERGE|TRUNCATE"

# Block comments nest; below this depth a further opening mark is plain comment text.
COMMENT_DEPTH = 8


def _block_comment(depth: int) -> str:
    """A block comment with others inside; one that is never closed reaches to the end of the text."""
    stars = r"\*++(?!/)|\*+(?=\*/)"  # stars that do not close, as whole runs
    if depth == 0:
        inside = rf"[^*]++|{stars}"
    else:
        inside = rf"[^*/]++|{stars}|/++(?!\*)|/+(?=/\*)|{_block_comment(depth - 1)}"
    return rf"/\*(?:{inside})*+(?:\*/|(?![\s\S]))"


# Token patterns. A doubled quote within a literal reads as two adjacent literals, which is the same.
LITERAL = r"'[^']*+'"
QUOTED_NAME = r"\[[^\]]{0,128}+\]|\"[^\"]*+\""
BLOCK_COMMENT = _block_comment(COMMENT_DEPTH)
COMMENT_MARKS = ("--", "/*")
COMMENT = rf"(?=['\[\"/-])(?:({LITERAL}|{QUOTED_NAME})|--[^\r\n]*+|{BLOCK_COMMENT})"
LITERAL_TEXT = rf"(?=['\[\"])(?:(')[^']*+(')|({QUOTED_NAME}))"

# Words that end the list of tables after FROM, at the same depth of parentheses.
FROM_LIST_END = (
    "SELECT|WHERE|GROUP|ORDER|HAVING|UNION|EXCEPT|INTERSECT|SET|VALUES|OPTION|WHEN|OUTPUT|INTO|FOR|"
    "EXEC|EXECUTE|DECLARE|IF|ELSE|BEGIN|END|PRINT|RETURN|WHILE|GO|COMMIT|ROLLBACK|RAISERROR|THROW|CLOSE|FETCH"
)

# Text patterns of procedure headers and terminal colours.
ANSI_COLOUR = r"\x1b\[[0-9;]+m|\[4m|\[0m"
# The body is taken whole and given back from its end, so that a closing END is found at once.
PROC_FRAME = (
    r"(?is)^.*?CREATE\s+PROC(?:EDURE)?\s+\[[^\]]+\]\.\[[^\]]+\].*?AS\s+BEGIN(?:(.*)(?<!\s)\s*+END\s*$|(.*)$)"
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def holds(sql: Column, needs: tuple[str, ...], lowered: Column | None = None) -> Column:
    """Whether a text has one of some short runs, whatever their case; NULL for NULL.

    ``lowered`` may be the same text in lower case, where the caller has it.
    """
    lowered = F.lower(sql) if lowered is None else lowered
    found = F.lit(False)
    for need in needs:
        found = found | F.contains(lowered if need.lower() != need.upper() else sql, F.lit(need.lower()))
    return found


def replace_where(sql: Column, needs: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """A regex replacement of which every match has one of ``needs``: texts without them are not searched."""
    return bound(sql, lambda s: F.when(holds(s, needs), F.regexp_replace(s, pattern, replacement)).otherwise(s))


def without(value: Column, characters: str) -> Column:
    """A text without some characters, each sought as bytes: ``translate`` looks up every character of the text."""
    for character in characters:
        value = F.replace(value, F.lit(character), F.lit(""))
    return value


def strip_comments(sql: Column) -> Column:
    """Text without comments; what looks like one inside a string literal or a quoted name stays."""
    return replace_where(sql, COMMENT_MARKS, COMMENT, "$1")


def mask_literals(sql: Column) -> Column:
    """Text with empty string literals: what they say is no statement of this text."""
    return replace_where(sql, ("'",), LITERAL_TEXT, "$1$2$3")


def from_lists(sql: Column) -> Column:
    """Commas between the tables of a FROM clause become JOIN.

    A running state over parentheses, commas and clause words tells these commas from all others: per
    depth of parentheses, whether the last clause word was FROM. Only statements that have a comma
    behind a FROM are walked; lists of constants are emptied first, so that they do not count.
    """
    concerned = r"(?i)(?=F)\bFROM\b(?:[^;,Ff]++|(?!\bFROM\b)[Ff])*+,"
    marks = rf'(?i)(?=[(),](?![^\[\]]{{0,128}}\])|(?<![\["@#.])\b(?:FROM|{FROM_LIST_END})\b)'

    def walk(seen: Column, piece: Column) -> Column:
        open_ = seen["open"]  # one digit per depth: 1 within the list of a FROM
        outer = F.substr(open_, F.lit(1), F.length(open_) - 1)
        after = (
            F.when(piece.startswith("("), F.concat(open_, F.lit("0")))
            .when(piece.startswith(")"), F.when(outer == "", F.lit("0")).otherwise(outer))
            .when(piece.startswith(","), open_)
            .when(piece.rlike(r"(?i)^FROM\b"), F.concat(outer, F.lit("1")))
            .when(piece.rlike(rf"(?i)^(?:{FROM_LIST_END})\b"), F.concat(outer, F.lit("0")))
            .otherwise(open_)
        )
        listed = piece.startswith(",") & open_.endswith("1")
        said = F.when(listed, F.concat(F.lit(" JOIN "), F.substr(piece, F.lit(2)))).otherwise(piece)
        return F.struct(after.alias("open"), F.concat(seen["said"], F.array(said)).alias("said"))

    def rewrite(statement: Column) -> Column:
        plain = F.regexp_replace(statement, r"\([^()A-Za-z_@#\[\"]*+\)", "()")
        nothing = F.struct(F.lit("0").alias("open"), F.array().cast("array<string>").alias("said"))
        return F.array_join(F.aggregate(F.split(plain, marks), nothing, walk, lambda seen: seen["said"]), "")

    rewritten = lambda whole: F.transform(F.split(whole, ";"), lambda s: F.when(s.rlike(concerned), rewrite(s)).otherwise(s))
    # Most texts have no comma left by now, and a comma is found as a byte.
    listed = lambda whole: F.contains(whole, F.lit(",")) & whole.rlike(concerned)
    return bound(sql, lambda whole: F.when(listed(whole), F.array_join(rewritten(whole), ";")).otherwise(whole))


def strip_ansi(sql: Column) -> Column:
    return replace_where(sql, ("\x1b", "[4m", "[0m"), ANSI_COLOUR, "")


def proc_body(sql: Column) -> Column:
    """Text after the first ``CREATE PROC [s].[n] … AS BEGIN``, without the closing END."""
    return F.regexp_replace(sql, PROC_FRAME, "$1$2")


def split_statements(sql: Column) -> Column:
    """A semicolon before statement keywords, and before SELECT / WITH that start a statement."""
    marked = F.regexp_replace(sql, rf"(?i)\s(?<!;\s)\s*+(?=[DIUMT])({STATEMENT_KEYWORDS})\b", ";$1")
    return split_queries(marked)


def split_queries(sql: Column) -> Column:
    """A semicolon before SELECT / WITH directly after a line start, ``;`` or END."""
    return F.regexp_replace(sql, r"(?imd)(?=[\s;E])(^|;|END)\s+(?=[SW])\b(SELECT|WITH)\b", "$1;$2")


def until_commit(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?is)(?=C)(\bCOMMIT\s+TRANSACTION\b).*", "$1")


def squeeze_ws(sql: Column) -> Column:
    # Other white space becomes a blank as a byte; what is left of runs after that is sought only where there is one.
    for character in "\t\n\x0b\f\r":
        sql = F.replace(sql, F.lit(character), F.lit(" "))
    return replace_where(F.trim(sql), ("  ",), r" {2,}+", " ")


def simplify_select(sql: Column) -> Column:
    """Column lists become ``*``; a list never reaches past the next SELECT, INTO or semicolon.

    The text is cut in front of every SELECT, so each piece holds one column list at most and
    a lazy scan to its first FROM or INTO is enough.
    """
    pieces = F.split(sql, r"(?i)(?=S)(?=\bSELECT\b)")
    short = F.transform(
        pieces,
        lambda piece: F.regexp_replace(
            piece, r"(?is)^SELECT\s+(TOP\s+\d+\s+|DISTINCT\s+)?[^;]*?(?=\s)(?=\s+(?:INTO|FROM)\b)", "SELECT $1*"
        ),
    )
    return F.array_join(short, "")


def normalise_sql(sql: Column, simplify: bool = True, first_transaction: bool = False) -> Column:
    """The cleaning steps applied before extraction, in order.

    ``first_transaction`` drops all that follows the first COMMIT TRANSACTION.
    """
    text = split_statements(proc_body(strip_ansi(sql)))
    text = squeeze_ws(until_commit(text) if first_transaction else text)
    return F.trim(simplify_select(text)) if simplify else text


# A character that no pattern takes for white space; stands for blanks inside brackets.
INNER_BLANK = "\u00a0"
# A character that no pattern takes for the end of a name; follows reserved words that were quoted.
QUOTED = "\u2060"


def unquote_identifiers(sql: Column, reserved: tuple[str, ...] = ()) -> Column:
    """Text without brackets and double quotes; blanks inside brackets are kept as ``INNER_BLANK``.

    Quoted ``reserved`` words are names; they get the mark ``QUOTED``. Identifiers are at most 128
    characters long, which bounds the look-ahead.
    """
    if reserved:
        quoted = rf"(?i)(?=[\[\"])(?:\[({'|'.join(reserved)})\]|\"({'|'.join(reserved)})\")"
        sql = replace_where(sql, ("[", '"'), quoted, "$1$2" + QUOTED)

    def bare(sql: Column) -> Column:
        kept = F.regexp_replace(sql, r"[ \t](?=[^\[\]]{0,128}\])", INNER_BLANK)
        return without(F.when(sql.rlike(r"\[[^\[\]\s]*[ \t]"), kept).otherwise(sql), '[]"')

    return bound(sql, bare)
