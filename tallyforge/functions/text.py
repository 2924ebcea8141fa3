"""Reading invoice fields out of a page's text, as column expressions.

All patterns are Java regular expressions with Unicode classes and case rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_I = "(?iU)"

# Month names, label patterns, boilerplate and money and date shapes decide what is read.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
MONEY = r"(?:[-−]\s*)?(?:[$€£₺]\s*)?(?:[A-Z]{3}\s*)?(-?\d{1,3}(?:[.,\s]\d{3})*(?:[.,]\d{2})|-?\d+[.,]\d{2})(?:\s*[A-Z]{3})?"
DATE = r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+\d{4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})"
NUMBER_LABELS = (
    r"\b(?:invoice|receipt|credit\s*note|credit\s*memo|tax\s*invoice|bill)[ \t]*(?:number|no\.?|nr\.?|num\.?|#|id)[ \t]*[:.]?[ \t]*([A-Z0-9][A-Z0-9/\-]*\d[A-Z0-9/\-]*)",
    r"\b(?:ref(?:erence)?|our[ \t]*ref)[ \t]*(?:number|no\.?|#)?[ \t]*[:.]?[ \t]*([A-Z0-9][A-Z0-9/\-]*\d[A-Z0-9/\-]*)",
    r"\b(?:invoice|receipt)[ \t]*#?[ \t]*([A-Z]{1,5}[\-/]?\d[A-Z0-9/\-]*|\d{3,})\b(?![ \t]*(?:date|due))",
)
TOTAL_LABELS = (
    r"total\s*payable", r"total\s*amount\s*due", r"balance\s*due", r"amount\s*due", r"total\s*due", r"grand\s*total",
    r"(?<!sub)(?<!sub\s)total\s*(?:incl\.?\s*(?:vat|tax|gst)|ttc|brutto)?",
)
JUNK = r"[^\w\n]{0,14}?"
DATE_LABELS = (
    r"\b(?:invoice\s*date|issue\s*date|issued|date\s*of\s*issue|tax\s*point)\s*[:.]?\s*" + DATE,
    r"(?<!due\s)(?<!due)\bdate\s*[:.]?\s*" + DATE,
    r"\breceipt\s*#?\s*\d+\s+" + DATE,
)
BARE_DATE = r"(?dm)^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\s*$"
VENDOR_LABEL = r"(?:vendor|from|sold\s*by|supplier|company)"
US_HINTS = r"\b(?:USD|EIN|\$|Sales tax|Net 30|, [A-Z]{2} \d{5})"
BOILERPLATE = (
    "invoice", "receipt", "bill to", "ship to", "page", "payment", "customer", "credit", "contact", "thanks", "please", "terms", "note",
    "due", "total", "order", "tax invoice", "date", "ref", "document", "account", "register", "for ", "issued", "commercial",
)
LONE_LABELS = ("name", "address", "number", "total", "amount", "description", "quantity")
COMPANY_ENDS = r"\b(ltd|inc|co|gmbh|a\.ş|s\.a|as|llc)\.?$"
ABBREVIATIONS = r"\b(?:ltd|inc|co|corp|gmbh|a\.ş|s\.a|s\.r\.l|as|llc|plc|pty|bv|nv|oy|ab|sas|sarl|kg|ag)\.$"
SCAN_LINES = 6
_LETTER = r"[A-Za-zÀ-ÿĀ-žİıŞşĞğ]"


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(text: Column) -> Column:
    """One kind of line end; a space where a label was glued to its value; plain spaces."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.translate(F.regexp_replace(text, r"([a-z])([A-Z]{2,}|(?U:\d))", "$1 $2"), "\u00a0", " ")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_amount(raw: Column) -> Column:
    """The last separator decides: two digits after it are cents, three make it a thousands separator, else there is no amount."""
    stripped = F.translate(F.regexp_replace(raw, r"^(?U:\s)+|(?U:\s)+$| ", ""), "−", "-")

    def value(s: Column) -> Column:
        tail = F.regexp_extract(s, r"(?s)[.,]([^.,]*)$", 1)
        head = F.regexp_extract(s, r"(?s)^(.*)[.,][^.,]*$", 1)
        digits = F.when(~s.rlike("[.,]"), s).when(F.length(tail) == 2, F.concat(F.translate(head, ".,", ""), F.lit("."), tail)).when(F.length(tail) == 3, F.translate(s, ".,", ""))
        return let(digits, lambda d: F.when(d.rlike(r"^\d+(\.\d*)?$"), d.try_cast("double")))

    return let(stripped, lambda s: F.when(F.startswith(s, F.lit("-")), -value(F.regexp_replace(s, "^-+", ""))).otherwise(value(s)))


def format_amount(amount: Column, style: Column) -> Column:
    """Two decimals in the style `us` (1,234.56), `eu` (1.234,56) or `plain` (1234.56), a minus first."""
    us = F.format_number(amount, 2)
    return F.when(style == "eu", F.translate(us, ",.", ".,")).when(style == "plain", F.translate(us, ",", "")).otherwise(us)


def _below_thousand(n: Column) -> Column:
    """1 to 999 in words, empty for 0."""
    word = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    rest, unit = n % 100, n % 10
    hundreds = F.when(n >= 100, F.concat(word(ONES, F.floor(n / 100)), F.lit(" hundred")))
    tens = F.concat_ws("-", word(TENS, F.floor(rest / 10)), F.when(unit > 0, word(ONES, unit)))
    return F.concat_ws(" ", hundreds, F.when(rest >= 20, tens).when(rest > 0, word(ONES, rest)))


def amount_words(amount: Column, currency: Column) -> Column:
    """Thousands and units in words and cents in figures, as on a cheque: `One hundred two eur and 05/100`.

    Groups of three digits are folded, so that a million is `one thousand
    thousand`. A negative amount begins with `minus`; null, and what isn't below ten million
    millions, is null.
    """

    def spell(cents: Column) -> Column:
        whole = (cents - cents % 100) / 100
        groups = F.transform(F.array(*[F.lit(1000**k) for k in range(4, -1, -1)]), lambda p: F.floor(whole / p) % 1000)

        def add(acc: Column, n: Column) -> Column:
            more = F.concat_ws(" ", acc, F.lit("thousand"), F.when(n > 0, _below_thousand(n)))
            return F.when(acc == "", _below_thousand(n)).otherwise(more)

        spelled = F.aggregate(groups, F.lit(""), add, lambda acc: F.when(acc == "", ONES[0]).otherwise(acc))
        text = F.concat_ws(" ", F.when(amount < 0, "minus"), spelled, F.lower(currency), F.lit("and"))
        text = F.concat(text, F.lit(" "), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("/100"))
        return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))

    return F.when(F.abs(amount) < 1e13, let(F.round(F.abs(amount) * 100).cast("long"), spell))


def _day(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(F.length(y) > 0, F.try_to_date(text, "yyyy-MM-dd"))


def _month(name: Column) -> Column:
    table = {m: k for k, m in enumerate(MONTHS, 1)} | {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, str(v))]), F.lower(name))


def parse_date(raw: Column, prefer_us: Column) -> Column:
    """Year first, day or month first, or with a month's name; a part over 12 tells day from month, else `prefer_us` does."""
    return let(F.regexp_replace(F.regexp_replace(raw, r"^(?U:\s)+|(?U:\s)+$", ""), "[.,]+$", ""), lambda s: _parsed_date(s, prefer_us))


def _parsed_date(s: Column, prefer_us: Column) -> Column:
    get = lambda p, g: F.regexp_extract(s, p, g)
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    num = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$"
    named = r"^(\d{1,2})(?U:\s)+([A-Za-z]{3,9})\.?,?(?U:\s)+(\d{4})$"
    first = r"^([A-Za-z]{3,9})\.?(?U:\s)+(\d{1,2}),?(?U:\s)+(\d{4})$"
    a, b, y = (get(num, g) for g in (1, 2, 3))
    ai, bi, yi = (x.try_cast("int") for x in (a, b, y))
    year = F.when(yi < 100, (yi + 2000).cast("string")).otherwise(y)
    month_first = F.when((ai > 12) & (bi <= 12), False).when((bi > 12) & (ai <= 12), True).otherwise(prefer_us)
    by_number = F.when(month_first, _day(year, a, b)).otherwise(_day(year, b, a))
    by_name = lambda p, d, m: F.when(_month(get(p, m)).isNotNull(), _day(get(p, 3), _month(get(p, m)), get(p, d)))
    return F.when(s.rlike(iso), _day(get(iso, 1), get(iso, 2), get(iso, 3))).when(s.rlike(num), by_number).when(s.rlike(named), by_name(named, 1, 2)).when(s.rlike(first), by_name(first, 2, 1))


def us_hint(text: Column) -> Column:
    return text.rlike(_I + US_HINTS)


def extract_number(text: Column) -> Column:
    """First candidate behind a label, labels in order, that isn't a date and has three characters or more."""
    lists = [F.regexp_extract_all(text, F.lit(_I + p), F.lit(1)) for p in NUMBER_LABELS]
    candidates = F.transform(F.concat(*lists), lambda c: F.regexp_replace(c, "[.,:]+$", ""))
    good = F.filter(candidates, lambda c: (F.length(c) >= 3) & parse_date(c, F.lit(True)).isNull())
    return F.get(good, F.lit(0))


def extract_amount(text: Column) -> Column:
    """The amount behind the most specific total label; the first label that occurs decides, even if its value can't be parsed."""
    patterns = [rf"\b{label}\b{JUNK}{MONEY}" for label in TOTAL_LABELS] + [MONEY + r"\s*due\b"]
    return parse_amount(F.coalesce(*[_found(text, _I + p) for p in patterns]))


def extract_date(text: Column) -> Column:
    us = us_hint(text)
    lists = F.concat(*[F.regexp_extract_all(text, F.lit(_I + p), F.lit(1)) for p in DATE_LABELS])
    dates = F.filter(F.transform(lists, lambda d: parse_date(d, us)), lambda d: d.isNotNull())
    return F.coalesce(F.get(dates, F.lit(0)), parse_date(_found(text, "(?U)" + BARE_DATE), us))


#: White space of any kind, inside brackets of a pattern with (?U); the separators of records and fields count as well.
BLANK = r"\s\x1c-\x1f"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^[{BLANK}]+|[{BLANK}]+$", "")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def looks_like_a_name(line: Column) -> Column:
    """Whether a line reads like a company's name rather than boilerplate, an address, a label or debris."""
    return let(line, lambda x: let(_words(x), lambda words: _name_like(x, words)))


def _name_like(line: Column, words: Column) -> Column:
    low, n = F.lower(line), F.size(words)
    boilerplate = F.lit(False)
    for start in BOILERPLATE:
        boilerplate = boilerplate | F.startswith(low, F.lit(start))
    letters = F.regexp_count(line, F.lit(r"\p{L}"))
    dense = letters / F.greatest(F.lit(1), F.length(F.replace(line, F.lit(" "), F.lit("")))) >= 0.75
    is_lower = (line == low) & line.rlike(r"\p{Ll}")
    lone = (n == 1) & (~line.rlike(r"^\p{Lu}") | low.isin(*LONE_LABELS))
    long_words = F.size(F.filter(words, lambda w: F.length(w) >= 3)) >= F.greatest(F.lit(1), F.floor(n / 2))
    is_upper = (line == F.upper(line)) & line.rlike(r"\p{Lu}")
    sentence = F.endswith(low, F.lit(".")) & ~is_upper & ~low.rlike("(?U)" + COMPANY_ENDS)
    return ~boilerplate & n.between(1, 6) & (letters > 0) & ~is_lower & ~lone & (F.regexp_count(line, F.lit(r"(?U)\d")) <= 3) & dense & long_words & ~sentence


def clean_vendor(name: Column) -> Column:
    """Without debris around it, a document type behind it, and header words that follow it on the line."""
    s = F.regexp_replace(name, r"(?U)^[^\w(]+", "")
    s = F.regexp_replace(s, r"(?iU)\s*[·|\-–—:.]*\s*(?:tax\s*)?(?:invoice|credit\s*note|receipt|statement)\s*$", "")
    s = F.get(F.split(s, r"(?iU)\s+(?:Document|Invoice|Customer|Tax\s+invoice|Date|VAT|Bill\s+to)\b", 2), F.lit(0))
    return let(_words(s), lambda words: let(_good_words(words), lambda kept: _without_point(F.array_join(kept, " "))))


def _good_words(words: Column) -> Column:
    """Without bad words at the head, where the last word always stays, and then without bad ones at the tail."""
    bad_head = lambda w: w.rlike(r"(?U)[^\w&'.-]") | ((F.length(w) <= 2) & ~w.isin("A", "I"))
    bad_tail = lambda w: ~w.rlike(_LETTER) | w.rlike(r"[+?*=<>|~^_@#%]")
    size = F.size(words)
    first = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(1), lambda at, i: F.when((i == at) & (i < size) & bad_head(F.get(words, i - 1)), i + 1).otherwise(at))
    kept = F.when(size > 0, F.slice(words, first, F.greatest(size, F.lit(1)))).otherwise(words)

    def tail(kept: Column) -> Column:
        count = F.size(kept)
        last = F.aggregate(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), F.lit(0), lambda n, i: F.when((i == n) & (i < count) & bad_tail(F.get(kept, count - 1 - i)), n + 1).otherwise(n))
        return F.slice(kept, F.lit(1), F.greatest(count - last, F.lit(0)))

    return let(kept, tail)


def _without_point(joined: Column) -> Column:
    trimmed = F.regexp_replace(joined, r"^[ ,\-·]+|[ ,\-·]+$", "")
    return let(trimmed, lambda s: F.when(F.endswith(s, F.lit(".")) & ~s.rlike(_I + ABBREVIATIONS), F.regexp_replace(s, r"\.$", "")).otherwise(s))


def vendor_lines(text: Column) -> Column:
    """The value of a vendor label on its line, that on the next line, and the first lines that aren't blank; empty if missing."""
    same = F.regexp_extract(text, rf"(?imdU)^{VENDOR_LABEL}\s*:?\s*(\S.*)$", 1)
    after = F.regexp_extract(text, rf"(?imdU)^{VENDOR_LABEL}\s*:?\s*$\n(.+)$", 1)
    lines = F.filter(F.transform(F.split(text, r"[\n\r\f\x0b\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    return F.concat(F.array(same, after), F.slice(lines, F.lit(1), F.lit(SCAN_LINES)))
