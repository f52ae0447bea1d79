"""Employer identity: keys, revision marks, aliases and the same-employer test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import let

# Words that an identity key leaves out, and the well-known other names of employers.
LEGAL_WORDS = "inc incorporated corp corporation co company ltd limited plc llc lp group holdings holding technologies technology systems solutions the com"
PLACE_WORDS = "america americas usa us international global worldwide na"
OTHER_NAMES = {
    "alphabet": "google|youtube|waymo", "meta": "facebook|meta platforms|instagram|whatsapp", "x": "twitter|x twitter", "amazon": "amazon com|amazon web services|aws|twitch|aws amazon|amazon fresh",
    "unitedhealth": "optum|unitedhealth|unitedhealthcare|united health", "block": "block square|square|cash app", "microsoft": "linkedin|github|xbox|activision blizzard|bungie",
    "hp": "hewlett packard|hewlett-packard|hp inc", "paramount": "paramount skydance|paramount global|cbs", "warner bros": "warner bros discovery|wbd|cnn|hbo", "comcast": "nbcuniversal|nbc universal|xfinity|versant",
    "saks": "saks fifth avenue|saks global|neiman marcus", "ford": "blueoval sk|blueoval|bosk", "general motors": "ultium cells|factory zero|gm",
    "conduent": "conduent commercial|conduent federal|conduent state local|conduent business process|conduent education|conduent state healthcare|conduent corporate|conduent commercial solutions",
    "tcs": "tata consultancy services", "bristol myers": "bristol myers squibb|bristol-myers squibb|bms", "jaguar land rover": "jlr|tata motors jlr|jaguar land rover automotive",
}
OTHER_SCRIPTS = {"捷豹路虎": "jaguar land rover", "ジャガー・ランドローバー": "jaguar land rover"}
REVISION_WORDS = "updated?|revised|revision|amended|amendment|corrected|correction"
# Words that do not tell one employer from another.
WEAK_WORDS = (
    "health healthcare motors motor steel bank media energy foods food retail stores store services service industries industrial national american united general first new north south east west central "
    "auto automotive air airlines airways insurance capital financial partners associates consulting digital labs works brands products mobility logistics university hospital medical school district county city state"
)
# Names that stand for no employer, words that describe one without naming it, legal forms that prove a name, and words that don't count.
NO_EMPLOYER = (
    "unknown|unknown company|unknown employer|n/a|na|none|null|undisclosed|undisclosed company|undisclosed employer|not disclosed|not specified|not stated|unnamed|unnamed company|unnamed employer|"
    "anonymous|confidential|various|multiple companies|tbd|unspecified"
)
GENERIC_WORDS = (
    "giant firm maker retailer chain manufacturer conglomerate multinational automaker carmaker supermarket grocer startup outfit major tech technology social media auto automotive parts online digital "
    "dtc ecommerce telecom telecoms pharma pharmaceutical semiconductor chip chips streaming gaming retail storage logistics aerospace"
)
LEGAL_FORMS = "llc llp lp inc incorporated ltd limited plc corp corporation co company gmbh ag sa sas nv bv ab as oy spa srl kk pte pty jsc ojsc pjsc sarl kg se aps doo dd"
SMALL_WORDS = "the a an and of for in at to s"
# Letters of other scripts are kept only outside these Latin ranges.
LATIN_RANGES = (
    r"\x{0080}-\x{036F}\x{1D00}-\x{1DFF}\x{1E00}-\x{1EFF}\x{2070}-\x{218F}\x{20D0}-\x{20FF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}\x{AB30}-\x{AB6F}\x{FB00}-\x{FB06}\x{FF00}-\x{FF5F}"
    r"\x{10780}-\x{107BF}\x{1D400}-\x{1D7FF}\x{1DF00}-\x{1DFFF}\x{1AB0}-\x{1AFF}\x{FE00}-\x{FE0F}\x{FE20}-\x{FE2F}\x{E0100}-\x{E01EF}"
)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def small_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def company_key(name: Column) -> Column:
    """Identity key: ASCII letters and digits without legal and place words; other scripts where nothing else is left; other names of one employer as one."""
    low = F.lower(name)

    def bare(chars: Column) -> Column:
        for words in (LEGAL_WORDS, PLACE_WORDS):
            chars = F.regexp_replace(chars, rf"\b(?:{words.replace(' ', '|')})\b", " ")
        return F.trim(F.regexp_replace(chars, r"\s+", " "))

    wide = bare(F.regexp_replace(low, rf"[{LATIN_RANGES}]|[^a-z0-9 \p{{L}}\p{{N}}\p{{M}}]", " "))
    known = {other: name for name, others in OTHER_NAMES.items() for other in others.split("|")}
    key = let(bare(F.regexp_replace(low, "[^a-z0-9 ]", " ")), lambda plain: F.when(plain == "", wide).otherwise(plain))
    return F.coalesce(F.try_element_at(small_map(OTHER_SCRIPTS), F.regexp_replace(low, r"\s+", "")), let(key, lambda k: F.coalesce(F.try_element_at(small_map(known), k), k)))


def without_revision_mark(name: Column) -> Column:
    """The name without the marks of a republished notice; a leading mark only where two key words are left."""
    tail = rf"(?i)(?:[\s*(\[{{,;:-]*\b(?:{REVISION_WORDS})\b[\s*)\]}}.,:;-]*)+$"
    head = rf"(?i)^(?:[\s*(\[{{]*\b(?:{REVISION_WORDS})\b[\s*)\]}}.,:;-]*)+"
    blank = r"^[\s*(){}\[\],.:;-]*$"
    cut = let(F.regexp_replace(name, tail, ""), lambda c: F.when(c.rlike(blank), name).otherwise(c))
    lead = lambda c: let(F.regexp_replace(c, head, ""), lambda x: F.when((x != c) & (F.size(F.split(company_key(x), " ")) >= 2), x).otherwise(c))
    return F.trim(let(cut, lead))


def tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda t: t != "")


def initials(words: Column) -> Column:
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), ""))


def same_employer(key_a: Column, key_b: Column, name_a: Column, name_b: Column) -> Column:
    """Whether two different keys name one employer: initials of the longer one, or all words of the shorter in the longer."""
    a_short = F.length(key_a) <= F.length(key_b)
    short, long = tokens(F.when(a_short, key_a).otherwise(key_b)), tokens(F.when(a_short, key_b).otherwise(key_a))
    raw = tokens(squeeze(F.regexp_replace(F.lower(F.when(a_short, name_b).otherwise(name_a)), "[^a-z0-9 ]", " ")))
    only = F.try_element_at(short, F.lit(1))
    short_form = (F.size(short) == 1) & only.rlike("^[A-Za-z]{2,}$") & (F.coalesce(initials(long) == only, F.lit(False)) | F.coalesce(initials(raw) == only, F.lit(False)))
    telling = F.exists(short, lambda t: ~F.array_contains(F.array(*map(F.lit, WEAK_WORDS.split())), t) & (F.length(t) > 2))
    inside = (F.size(short) > 0) & (F.size(F.array_except(short, long)) == 0) & (F.size(F.array_distinct(short)) != F.size(F.array_distinct(long))) & telling
    return (F.trim(key_a) != "") & (F.trim(key_b) != "") & (F.trim(key_a) != F.trim(key_b)) & (short_form | inside)


def is_anonymous(name: Column) -> Column:
    """Whether a name stands for no employer: a placeholder, or two words or more that only describe one; a legal form makes any name real."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]+", " ")))
    known = squeeze(F.regexp_replace(low, "[^a-z0-9/ ]+", " "))
    words = F.filter(F.split(known, " "), lambda w: w != "")
    one_of = lambda text: F.array(*map(F.lit, text.split()))
    telling = F.filter(words, lambda w: ~F.array_contains(one_of(SMALL_WORDS), w))
    described = (F.size(telling) >= 2) & F.forall(telling, lambda w: F.array_contains(one_of(GENERIC_WORDS), w)) & ~F.arrays_overlap(words, one_of(LEGAL_FORMS))
    return (low == "") | known.isin(*NO_EMPLOYER.split("|")) | described


# Legal forms at the end of a registered name.
LEGAL_SUFFIXES = (
    "inc incorporated corp corporation co company ltd limited llc llp lp plc pllc gmbh ag kg mbh ug se sa sas sarl de cv nv bv ab as asa oy oyj aps spa srl sl sll kk pte pty bhd sdn tbk pt jsc pjsc ojsc "
    "oao zao ooo sro spol kft zrt lda ltda eirl cia sociedad anonima aktiengesellschaft"
)


def _without_accents(names: pd.Series) -> pd.Series:
    return names.fillna("").str.normalize("NFKD").str.replace(r"[\u0300-\u036f]", "", regex=True).str.casefold()


def legal_name(name: Column) -> Column:
    """Legal names for matching: case and accents off, ``&`` as a word, dots and punctuation off, trailing legal forms and a leading article off."""
    # The only step that no built-in function has: letters are taken apart from their accents, in Arrow batches.
    plain = F.pandas_udf(_without_accents, StringType())(name)
    base = F.regexp_replace(F.regexp_replace(plain, "&", " and "), "\\.", "")
    base = squeeze(F.regexp_replace(base, r"[^\p{L}\p{N}\s]|_", " "))
    forms = LEGAL_SUFFIXES.replace(" ", "|")
    tail = rf"(?:(?:^| )(?:{forms}))*(?:(?:(?:^| )and)+(?:(?:^| )(?:{forms}))*)*$"
    return F.regexp_replace(F.trim(F.regexp_replace(base, tail, "")), "^the (?=.)", "")


def starts_with_words(short: Column, long: Column) -> Column:
    """Whether a key begins with all words of another."""
    a, b = tokens(short), tokens(long)
    return (F.size(a) > 0) & (F.slice(b, F.lit(1), F.size(a)) == a)


def names_align(a: Column, b: Column) -> Column:
    """Whether one of two keys begins with all words of the other."""
    return starts_with_words(a, b) | starts_with_words(b, a)
