"""Predicates and rewrites of single lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import let

# Character classes that decide languages and scripts.
KANA = r"[぀-ゟ゠-ヿㇰ-ㇿｦ-ﾟ]"
KANA_LETTERS = r"[぀-ゟ゠-ヺヽ-ヿ]"
HAN = r"[一-鿿]"
KANA_OR_HAN = r"[぀-ゟ゠-ヺ一-鿿]"
CJK_WIDE = r"⺀-⻿　-〿぀-ゟ゠-ヿ㈀-㋿㐀-䶿一-鿿豈-﫿＀-￯"
ALIGN_SYMBOLS = r"[♡♢♥☆＊※〜～…・…、。\s\"“”‘’「」『』（）()!！?？·\-—_~^]"
ECHO_SYMBOLS = r"[\s　、。。？?！!「」『』…—―～~♡♪・，．\.，,\(\)（）\[\]【】:：;\"'“”‘’]"
HEADER_WORDS = r"製糖|製作|発行|著作"
NOISE_SOUNDS = r"^[ぁ-んァ-ン♥……っ！!～~。、\s]+$"

# Closing and opening phrases that recognisers invent in silence.
ENDINGS = (
    "ありがとう", "有難う", "ありがと", "谢谢", "感謝", "お疲れ様", "お疲れさまでした", "お疲れ", "辛苦了", "辛苦了啊", "这次就到这里", "就到这里", "作品到此结束", "到此结束",
    "thank you", "thanks", "thank you for listening", "thank you for watching", "thank you for purchasing", "goodbye", "bye", "see you next time",
)
OPENINGS = (
    "こんにちは", "こんばんは", "おはようございます", "おはよう", "ようこそ", "いらっしゃいませ", "いらっしゃい", "始めましょう", "始めます", "始まります", "皆さん", "みなさん", "皆様", "みな様",
    "お待たせしました", "お待たせ", "ただいま", "ただいまより", "それでは始め", "では始め", "じゃあ始め", "大家好", "各位好", "你们好", "欢迎来到", "欢迎收听", "欢迎观看", "开始吧", "我们开始", "开始了",
    "hello", "hi there", "welcome", "let's start", "let us start", "starting now",
)
SHORT_LINES = (
    r"^[あア]りがとう[ございましたます]?[。．\.]?$", r"^[おオ]疲れ様?[でしたです]?[。．\.]?$", r"^[さサ]ようなら[。．\.]?$", r"^[ばバイ]い[ばバイ]い[。．\.]?$",
    r"^thank\s*you[。．\.]?$", r"^thanks[。．\.]?$", r"^bye[。．\.]?$", r"^goodbye[。．\.]?$", r"^感谢[收听观看购买支持]", r"^谢谢[收听观看购买支持]",
    r"^[こコ]んにちは[。．\.]?$", r"^[おオ]はよう[ございます]?[。．\.]?$", r"^[いイ]らっしゃい[ませ]?[。．\.]?$", r"^[はハ]じめ[ましょう]?[。．\.]?$",
    r"^[みミ]なさん[。．\.]?$", r"^[おオ]待たせ[しました]?[。．\.]?$", r"^hello[。．\.]?$", r"^hi[。．\.]?$", r"^welcome[。．\.]?$", r"^大家好[。．\.]?$", r"^欢迎[。．\.]?$",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trim Unicode white space (``trim`` takes blanks only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def compact(x: Column | str) -> Column:
    """the text without white space."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s", "")


def compact_length(x: Column | str) -> Column:
    return F.length(compact(x))


def has_kana(x: Column | str) -> Column:
    """P1."""
    return F.rlike(_c(x), F.lit(KANA))


def has_han(x: Column | str) -> Column:
    """P2."""
    return F.rlike(_c(x), F.lit(HAN))


def count_class(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(x), F.lit(pattern)).cast("long")


def file_language(kana: Column, han: Column, texts: Column) -> Column:
    """P3, from counts over the texts of a file: letters of kana, han, and the number of texts."""
    spoken = (kana > 0) & (han > 0) & (kana.cast("double") / han > 0.1)
    return F.when(texts == 0, "empty").when(spoken | ((kana > 0) & (han == 0)), "japanese").when(han > 0, "chinese").otherwise("unknown")


def content_language(content: Column | str) -> Column:
    """Ja, zh, en, mixed or unknown for a whole timed-lyrics file."""
    lines = F.transform(F.split(_c(content), "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)\[\d{2}:\d{2}\.\d{2,3}\]", "")))
    words = F.filter(lines, lambda x: (x != "") & ~F.rlike(x, F.lit(r"^\[(ti|ar|al|by|offset):")))
    text = F.array_join(words, " ")
    size = F.length(F.replace(text, F.lit(" "), F.lit("")))
    latin = F.regexp_count(text, F.lit("[a-zA-Z]")) / F.nullif(size, F.lit(0))
    kana, han = has_kana(text), has_han(text)
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "unknown")
        .when(kana, F.when(han & (latin < 0.3), "ja").when(latin > 0.5, "mixed").otherwise("ja"))
        .when(han, F.when(latin < 0.3, "zh").otherwise("mixed"))
        .when(latin > 0.7, "en")
        .otherwise("unknown")
    )


def is_chinese(kana: Column, han: Column, sibling_kana: Column | None = None, strict: bool = False) -> Column:
    """P5: han without much kana, also judged against the kana of a sibling original."""
    plain = (han > 0) & (kana == 0)
    if strict:
        return plain
    loose = (han > 0) & (kana <= 0.1 * han)
    if sibling_kana is not None:
        loose = loose | ((han > 0) & (sibling_kana > 0) & (kana <= 0.5 * sibling_kana))
    return plain | F.coalesce(loose, F.lit(False))


def is_page_number(x: Column | str) -> Column:
    """One to four digits, or n/m."""
    return F.rlike(strip(x), F.lit(r"(?U)^\d{1,4}$|^\d{1,4}\s*/\s*\d{1,4}$"))


def is_header_footer(x: Column | str) -> Column:
    """P7."""
    return F.rlike(_c(x), F.lit(HEADER_WORDS))


def page_noise(x: Column | str) -> Column:
    """P8 for one line: the line to keep, or null if it goes.

    Lines of eight and more leading digits keep what follows the digits.
    """
    x, s = _c(x), strip(x)
    digits_only = F.rlike(s, F.lit(r"(?U)^\d+$"))
    run = F.rlike(s, F.lit(r"(?U)(\d)\1{3,}")) & (F.regexp_count(s, F.lit(KANA_OR_HAN)) == 0)
    rest = strip(F.regexp_replace(s, r"(?U)^\d+\s*", ""))
    return F.when(is_page_number(s) | is_header_footer(s) | digits_only | run, F.lit(None)).when(F.rlike(s, F.lit(r"(?U)^\d{8,}")), F.nullif(rest, F.lit(""))).otherwise(x)


def filter_page_noise(text: Column | str) -> Column:
    """P8 over the lines of a text."""
    return F.array_join(F.array_compact(F.transform(F.split(_c(text), "\n"), page_noise)), "\n")


def is_noise_line(x: Column | str) -> Column:
    """Blank, a ※ note, or a short line of sounds only."""
    s = strip(x)
    return (s == "") | F.startswith(s, F.lit("※")) | (F.rlike(s, F.lit("(?U)" + NOISE_SOUNDS)) & (F.length(s) < 8))


def boilerplate_kind(text: Column | str, position: Column) -> Column:
    """Which invented phrase a line is, by its position in the file (0 to 1); null if none."""
    text = _c(text)
    short = "(?U)" + "|".join(f"(?:{p})" for p in SHORT_LINES)

    def first_of(phrases: tuple[str, ...], low: Column) -> Column:
        forms = F.array(*[F.struct(F.lit(p).alias("p"), F.lower(F.lit(p)).alias("low")) for p in phrases])
        return F.get(F.filter(forms, lambda x: F.contains(low, x["low"]) | F.contains(text, x["p"])), F.lit(0))["p"]

    def kind(low: Column) -> Column:
        ending, opening = first_of(ENDINGS, low), first_of(OPENINGS, low)
        named = F.coalesce(
            F.when(position < 0.9, F.concat(F.lit("mid_file_ending:"), ending)),
            F.when(position > 0.1, F.concat(F.lit("late_file_opening:"), opening)),
            F.when((position < 0.9) & F.rlike(low, F.lit(short)), F.lit("short_ending_pattern")),
        )
        return F.when(low != "", named)

    # Bound to a name, as the form would else be worked out again for every phrase.
    return let(F.lower(strip(text)), kind)


def repeats_too_much(text: Column | str, most: int = 5) -> Column:
    """A run of one character, or a two- or three-character head that fills most of the text."""
    text = _c(text)
    size, times = F.length(text), most // 2 + 1
    out = F.rlike(text, F.lit(rf"(?s)(.)\1{{{most - 1},}}"))
    for n in (2, 3):
        head = F.substring(text, 1, n)
        count = (size - F.length(F.replace(text, head, F.lit("")))) / F.length(head)
        out = out | ((size >= n * times) & (n * count > size * 0.7) & (count >= times))
    return F.coalesce((size >= most) & out, F.lit(False))


def drop_reason(line: Column | str, position: Column, most: int = 5, least_length: int = 3) -> Column:
    """Why a recognised line is dropped, or null if it stays (blank lines stay)."""
    def reason(text: Column) -> Column:
        later = F.when(repeats_too_much(text, most), "repetition").when(F.length(text) < least_length, "short").when(F.rlike(text, F.lit(r"(?U)^[\d\s\W_]+$")), "symbols").when(~has_kana(text) & ~has_han(text), "no_script")
        return F.when(text != "", F.coalesce(boilerplate_kind(text, position), later))

    return let(strip(F.regexp_replace(_c(line), r"(?U)^\d{2,3}:\s*", "")), reason)


# --- rewrites -----------------------------------------------------------------------------------------

KATAKANA = "".join(chr(0x30A1 + i) for i in range(86))
HIRAGANA = "".join(chr(0x3041 + i) for i in range(86))


def align_normal(x: Column | str, reading=None) -> Column:
    """without symbols, in hiragana; ``reading`` may turn the text into its sound first."""
    bare = F.regexp_replace(_c(x), "(?U)" + ALIGN_SYMBOLS, "")
    return F.translate(reading(bare) if reading else bare, KATAKANA, HIRAGANA)


def echo_normal(x: Column | str) -> Column:
    """without punctuation and blanks."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), "(?U)" + ECHO_SYMBOLS, "")


def without_number(x: Column | str) -> Column:
    """without a line number like ``0001: ``."""
    return strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\d+:\s*", ""))


def pre_clean(x: Column | str) -> Column:
    """F8: page marks, sound-effect lines and page-number lines go; blank runs shrink to one line."""
    out = _c(x)
    for pattern, by in (
        (r"(?U)<!--\s*page\s+\d+\s*-->", ""), (r"ＳＥ：[^\n]*", ""), (r"(?iU)SE\s*[:：][^\n]*", ""),
        (r"(?mU)^\d{1,4}\s*$", ""), (r"(?mU)^\d+/\d+\s*$", ""), (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def merge_short_lines(text: Column | str, least: int = 10) -> Column:
    """a line shorter than ``least`` joins the line above unless it starts with a marker."""
    start = F.array().cast("array<string>")

    def step(acc, line):
        s, last = strip(line), F.try_element_at(acc, F.lit(-1))
        joins = (s != "") & (F.coalesce(last, F.lit("")) != "") & (F.length(s) < least) & ~F.rlike(s, F.lit("^[◆■○●]"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, s)))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(F.split(_c(text), "\n"), start, step)
    return F.array_join(F.filter(merged, lambda x: x != ""), "\n")


def join_cjk(x: Column | str, keep_newlines: bool = False) -> Column:
    """without the blanks between CJK characters (line feeds count as blanks unless kept)."""
    gap = r"[^\S\n]+" if keep_newlines else r"\s+"
    return F.regexp_replace(_c(x), rf"(?U)(?<=[{CJK_WIDE}]){gap}(?=[{CJK_WIDE}])", "")


def clean_number_lines(text: Column | str) -> Column:
    """lines lose up to three leading digits; blank lines, marks and digit lines stay."""

    def one(line):
        s = strip(line)
        cut = F.regexp_replace(s, r"(?U)^\d{1,3}(?=[^\d\s])", "")
        stays = (s == "") | F.startswith(s, F.lit("<!--")) | F.rlike(s, F.lit(r"(?U)^\d+$"))
        return F.when(stays, line).when((cut != "") & ~F.rlike(cut, F.lit(r"(?U)^\d+$")), cut).otherwise("")

    return F.array_join(F.transform(F.split(_c(text), r"\r\n|\r|\n"), one), "\n")


def without_brackets(x: Column | str) -> Column:
    """without bracketed notes, closed or not."""
    out = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[（(][^）)]*[）)]", "")
    return strip(F.regexp_replace(out, r"[（(].*$", ""))


def bigrams(x: Column | str) -> Column:
    """Distinct pairs of neighbouring letters; the text is taken apart once, not searched for every place."""
    pairs = lambda c, n: F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b))
    return let(F.split(_c(x), ""), lambda c: F.array_distinct(pairs(c, F.greatest(F.size(c) - 1, F.lit(0)))))


def dice(a: Column | str, b: Column | str) -> Column:
    """Twice the shared distinct bigrams over all; 0 if either text is shorter than two."""
    x, y = bigrams(a), bigrams(b)
    total = F.size(x) + F.size(y)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)
