"""Text rules as corpus jobs: each returns findings, or tables that rules need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import INVISIBLE, KO_PARTICLES, has_final_consonant, letter_distance, normalise_text
from lexiloom.operators.matching import counts_in_text

# Forms after a final consonant and after a vowel; dependent nouns; wrong stems with the right ones;
# places of a particle after a bracket; labels that a particle does not agree with; characters inside an anchor;
# closing brackets; dependent nouns of any length that stand apart after them; words of headings and their category.
PARTICLE_FORMS = (("은", "는"), ("이", "가"), ("을", "를"), ("과", "와"), ("아", "야"))
DEPENDENT_NOUNS = ("것", "수", "바", "줄", "만큼", "대로", "뿐", "데")
WRONG_STEMS = (
    ("아니였", "아니었"), ("파라메터", "파라미터"), ("됬", "됐"), ("뵈요", "봬요"), ("왠만", "웬만"), ("왠걸", "웬걸"), ("어떻해", "어떡해"),
    ("곰곰히", "곰곰이"), ("낱낱히", "낱낱이"), ("샅샅히", "샅샅이"), ("틈틈히", "틈틈이"), ("뿔뿔히", "뿔뿔이"), ("넉넉치", "넉넉지"), ("섭섭치", "섭섭지"),
    ("생각컨대", "생각건대"), ("치뤄", "치러"), ("치뤘", "치렀"), ("잠궜", "잠갔"), ("담궈", "담가"), ("담궜", "담갔"), ("바꼈", "바뀌었"), ("무릎쓰", "무릅쓰"),
)
PAREN_PARTICLE = r"([가-힣]+) ?\(([^()]{0,60})\)(으로|로|은|는|이|가|을|를|과|와)($|[^가-힣])"
PAREN_LABEL = r"^\s*[0-9][0-9\s.,·\-]*$"
ANCHOR = r"[\p{L}\p{N}._/-]"
CLOSING = (")", "]", "}", "』", "」", "】", "》", "〉", "）", "］", "｝")
NOUNS_APART = ("시", "때", "중", "외", "수", "것", "데", "바", "줄", "만큼", "대로", "뿐", "들", "등", "등등", "따위", "년", "월", "일", "말", "초", "경", "무렵")
RULE_CATEGORIES = (("띄어쓰기", "띄어쓰기"), ("외래어", "외래어"), ("표준", "표준어"), ("발음", "표준어"))


def corpus_load(docs: DataFrame, least: int = 10, large: int = 15_000) -> DataFrame:
    """Normalised texts with their characters other than space; short ones go, large ones are flagged."""
    clean = docs.select("doc_id", normalise_text(F.col("text")).alias("text"))
    n = F.length(F.regexp_replace("text", r"\s", ""))
    return clean.withColumn("n_chars_ns", n).where(F.col("n_chars_ns") >= least).withColumn("is_large", F.col("n_chars_ns") > large)


def token_filter_urlish(words: DataFrame, col: str = "word") -> DataFrame:
    """Tokens that are no URL, path or e-mail address and hold no invisible character."""
    urlish = F.col(col).rlike(r"://|^www\.|@|[/\\]|\.(com|org|net|html?)\b")
    return words.where(~urlish & ~F.col(col).rlike(INVISIBLE))


def rule_lines_noise(lines: DataFrame) -> DataFrame:
    """Lines that are no page number, dotted leader or blank."""
    return lines.where(~F.col("text").rlike(r"^\s*(-\s*)?[0-9]+(\s*-)?\s*$|\.{4,}|^\s*$"))


def _chunks(text: Column, pieces: Column, total: Column, most: int, ends, splits, quotes) -> Column:
    """``text`` as an array of chunks of up to ``most`` characters, cut between ``pieces``.

    ``ends`` (of a piece) says that a sentence may end with it, ``splits`` that a sentence of over ``most`` may be cut
    after it, ``quotes`` how many quotation marks it holds, of ``total``; between the two of a pair nothing is cut. One fold over the
    pieces carries places, not texts: where the text, the chunk and the sentence are, the last place where the chunk may
    end, and the cuts that the sentence needs if it turns out too long. Only a chunk appends to an array.
    """
    cuts = F.array().cast("array<int>")
    fields = ("at", "marks", "chunk", "last", "done", "sentence", "part", "part_last", "part_done")
    state = lambda *values: F.struct(*[v.alias(n) for n, v in zip(fields, values, strict=True)])
    zero = F.lit(0)
    push = lambda array, place, when: F.when(when, F.concat(array, F.array(place))).otherwise(array)
    size = F.length(text)

    def step(s: Column, p: Column) -> Column:
        at, marks = s["at"] + F.length(p), s["marks"] + quotes(p)
        inside = (marks % 2 == 1) & (marks < total)
        closes = (at == size) | (ends(p) & ~inside)
        split = splits(p) & ~inside
        over = (closes | split) & (at - s["part"] > most) & (s["part_last"] > s["part"])  # cut the sentence at its last place
        part, part_done = F.when(over, s["part_last"]).otherwise(s["part"]), push(s["part_done"], s["part_last"], over)
        whole = at - s["sentence"] <= most
        full = F.when(whole, at - s["chunk"] > most).otherwise(True) & (s["last"] > s["chunk"])  # the chunk ends before the sentence
        chunk, done = F.when(full, s["last"]).otherwise(s["chunk"]), push(s["done"], s["last"], full)
        open_ = state(at, marks, s["chunk"], s["last"], s["done"], s["sentence"], part, F.when(split, at).otherwise(s["part_last"]), part_done)
        closed = state(at, marks, F.when(whole, chunk).otherwise(F.greatest(chunk, part)), at, F.when(whole, done).otherwise(F.concat(done, part_done)), at, at, at, cuts)
        return F.when(closes, closed).otherwise(open_)

    places = F.aggregate(pieces, state(*[zero] * 4, cuts, *[zero] * 3, cuts), step, lambda s: s["done"])
    between = F.zip_with(F.concat(F.array(zero), places), F.concat(places, F.array(size)), lambda a, b: F.substring(text, a + 1, b - a))
    return F.when(size > 0, between).otherwise(F.array().cast("array<string>"))


def _chunked(docs: DataFrame, pattern: str, most: int, ends, splits, quotes) -> DataFrame:
    # Bound as an array element, pieces and their marks are worked out once, not in every step.
    found = F.struct("text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("pieces"), quotes(F.col("text")).alias("total"))
    bound = F.transform(F.array(found), lambda x: _chunks(x["text"], x["pieces"], x["total"], most, ends, splits, quotes))
    return docs.select("doc_id", F.posexplode(F.flatten(bound)).alias("chunk_id", "text"))


def chunk_documents(docs: DataFrame, most: int) -> DataFrame:
    """Greedy packing of sentences into chunks of up to ``most`` characters: doc_id, chunk_id, text.

    A sentence ends with marks and white space, or with a line. A longer one is a chunk of its own, or several, cut
    after commas. Nothing is cut between quotation marks of a pair (straight, curved or wide, paired in order); one
    left over pairs with nothing. What has no such place stays whole. Chunks joined give the text back; null and empty texts have none.
    """
    marks = '["\u201c\u201d\uff02]'
    pattern = r"[^.!?,\n]*(?:[.!?]+[^\S\n]*\n*|\n+|,)|[^.!?,\n]+"
    return _chunked(docs, pattern, most, lambda p: p.rlike(r"\s\z"), lambda p: F.endswith(p, F.lit(",")), lambda p: F.regexp_count(p, F.lit(marks)))


def chunk_paragraphs(docs: DataFrame, most: int) -> DataFrame:
    """The same packing over whole lines: no chunk ends inside a paragraph, one longer than ``most`` is a chunk of its own."""
    yes, no = (lambda p: F.lit(True)), (lambda p: F.lit(False))
    return _chunked(docs, r"[^\n]*\n|[^\n]+", most, yes, no, lambda p: F.lit(0))


def rule_fill_forward(lines: DataFrame) -> DataFrame:
    """Each line with the last heading (a line that starts with a capital and has one word) before it, and its number."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("text").rlike(r"^\p{Lu}\S*\s*$"), F.col("text"))
    marked = lines.withColumn("heading", heading)
    return marked.select("doc_id", "line_no", F.last("heading", ignorenulls=True).over(w).alias("section"), F.sum(F.col("heading").isNotNull().cast("long")).over(w).alias("article"))


def fragment_context(lines: DataFrame) -> DataFrame:
    """Body lines that follow an interrupting note line (with ``|``), with the body line before the note."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    note = F.col("text").contains("|")
    marked = lines.where("trim(text) <> ''").withColumn("note", note)
    body = F.last(F.when(~F.col("note"), F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = marked.withColumn("before", body).withColumn("after_note", F.lag("note").over(w))
    return out.where("not note and after_note and before is not null").select("doc_id", "line_no", "before")


def author_abbreviations(docs: DataFrame) -> DataFrame:
    """Short forms that the author declares, "(이하 X)"."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(이하 ([^)]+)\)"), F.lit(1))).alias("term")).distinct()


def hanja_readings(docs: DataFrame) -> DataFrame:
    """Words with Han characters in brackets after them."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([가-힣]+)\([一-龥]+\)"), F.lit(1))).alias("term")).distinct()


def _findings(docs: DataFrame, rule: str, pattern: str, replacement: str) -> DataFrame:
    """Findings of a pattern: the matched text and the text it should be."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n", "original"))
    return found.select("doc_id", F.lit(rule).alias("rule"), "n", "original", F.regexp_replace("original", pattern, replacement).alias("corrected")).where("original <> corrected")


def punct_spacing(docs: DataFrame) -> DataFrame:
    """A space is missing between a sentence mark and Hangul."""
    return _findings(docs, "punct_spacing", r"([가-힣])([.?!])([가-힣])", "$1$2 $3")


def unit_spacing(docs: DataFrame) -> DataFrame:
    """A number with a big unit is parted from the noun it counts."""
    return _findings(docs, "unit_spacing", r"([0-9]+[만억천])([명원개])", "$1 $2")


def spelling_stems(docs: DataFrame) -> DataFrame:
    """Tokens with a wrong stem, rewritten by the first stem pair that fits. The pairs are few and fixed."""
    words = docs.select("doc_id", F.explode(F.split("text", r"\s+")).alias("original"))
    fixed = F.lit(None).cast("string")
    for wrong, right in reversed(WRONG_STEMS):
        fixed = F.when(F.col("original").contains(wrong), F.replace("original", F.lit(wrong), F.lit(right))).otherwise(fixed)
    return words.select("doc_id", F.lit("spelling_stems").alias("rule"), "original", F.trim(fixed).alias("corrected")).where("corrected is not null and corrected <> original")


def _agrees(noun: Column, particle: Column) -> Column:
    """The form of ``particle`` that agrees with the last syllable of ``noun``; after a final rieul as after a vowel for -ro."""
    last = F.right(noun, F.lit(1))
    closed, rieul = has_final_consonant(last), (F.ascii(last) - 44032) % 28 == 8
    out = F.when(particle.isin("으로", "로"), F.when(closed & ~rieul, "으로").otherwise("로")).otherwise(particle)
    for after_consonant, after_vowel in PARTICLE_FORMS:
        out = F.when(particle.isin(after_consonant, after_vowel), F.when(closed, after_consonant).otherwise(after_vowel)).otherwise(out)
    return out


def paren_particle(docs: DataFrame) -> DataFrame:
    """A particle after ``noun(...)`` agrees with the noun's final consonant; the bracket follows the noun directly.

    Brackets that hold a number or label only are left alone: the particle agrees with how that is read. A null text
    has no findings; a finding is given once a document.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PAREN_PARTICLE), F.lit(0))).alias("m"))
    part = lambda n: F.regexp_extract("m", PAREN_PARTICLE, n)
    parts = found.select("doc_id", F.expr("substring(m, 1, length(m) - 1)").alias("inside"), part(1).alias("noun"), part(2).alias("inner"), part(3).alias("particle"), part(4).alias("after"), "m")
    right = _agrees(F.col("noun"), F.col("particle"))
    original = F.when(F.col("after") == "", F.col("m")).otherwise(F.col("inside"))
    wrong = parts.where(~F.col("inner").rlike(PAREN_LABEL)).where(right != F.col("particle"))
    return wrong.select("doc_id", F.lit("paren_particle").alias("rule"), original.alias("original"), F.concat("noun", F.lit("("), "inner", F.lit(")"), right).alias("corrected")).distinct()


def fix_paren_agreement(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """Corrections (doc_id, original, corrected, ...) whose only change is the particle after a closing bracket, made to agree.

    The particle agrees with the Hangul syllable before the bracket; where the original starts inside the bracket, the
    document's text before it is read too. A correction that becomes its original goes. Left as they are: particles
    followed by Hangul, brackets of numbers and labels or without Hangul before them, nested ones of a kind, and
    corrections with a null.
    """
    o, c = F.col("original"), F.col("corrected")
    same = F.expr("aggregate(sequence(0, least(length(original), length(corrected))), 0, (n, i) -> if(n = i - 1 and substring(original, i, 1) = substring(corrected, i, 1), i, n))")
    particle = r"^(으로|로|은|는|이|가|을|를|과|와)($|[^가-힣].*)"
    text = docs.select("doc_id", "text").dropDuplicates(["doc_id"])
    x = corrections.withColumn("_n", same)
    x = x.withColumn("_before", F.expr("substring(original, 1, _n)")).withColumn("_old", F.expr("substring(original, _n + 1)")).withColumn("_new", F.expr("substring(corrected, _n + 1)"))
    get = lambda col, n: F.regexp_extract(col, "(?s)" + particle, n)
    swap = F.col("_before").rlike(r"[)）\]〕】]\z") & (get("_old", 1) != "") & (get("_new", 1) != "") & (get("_old", 2) == get("_new", 2))
    x = x.withColumn("_swap", F.coalesce(swap, F.lit(False)))
    x = x.join(text.withColumnRenamed("text", "_text"), "doc_id", "left")
    at = F.expr("instr(_text, original)")
    before = F.when(F.col("_before").rlike(r"[(（\[〔【]"), F.col("_before")).otherwise(F.concat(F.when(at > 0, F.expr("substring(_text, greatest(1, instr(_text, original) - 100), least(100, instr(_text, original) - 1))")).otherwise(""), F.col("_before")))
    bracket = r"([가-힣]) ?(?:\(([^()]*)\)|（([^（）]*)）|\[([^\[\]]*)\]|〔([^〔〕]*)〕|【([^【】]*)】)\z"
    x = x.withColumn("_host", F.when(F.col("_swap"), F.regexp_extract(before, bracket, 1))).withColumn("_inner", F.concat(*[F.regexp_extract(before, bracket, k) for k in range(2, 7)]))
    known = F.coalesce((F.col("_host") != "") & ~F.col("_inner").rlike(PAREN_LABEL), F.lit(False))
    fixed = F.when(known, F.concat("_before", _agrees(F.col("_host"), get("_new", 1)), get("_new", 2))).otherwise(c)
    out = x.withColumn("corrected", fixed).where(~(known & (F.col("corrected") == o)))
    return out.select(corrections.columns)


def anchor_narrow(docs: DataFrame, fix, least: int = 1) -> DataFrame:
    """Findings of ``fix`` (a function from a token column to its text with spaces put in), each on its smallest anchor.

    An anchor is what stands around the new spaces, as far as letters, digits and ``._/-`` reach. It is taken if every
    place of that text in the document, overlapping ones too, is one that ``fix`` changes; else the whole token is
    the original. Tokens whose fix changes more than spaces are left out. Of findings on one original in a document
    the first stays. Texts are read in their rows, for all anchors at once. A null text has no findings.
    """
    shape = rf"^(\S*?)((?:[\p{{L}}\p{{N}}]{ANCHOR}*)?\S(?: \S+)* \S(?:{ANCHOR}*[\p{{L}}\p{{N}}])?)(\S*)$"

    def finding(x: Column) -> Column:
        fixed = x["token_fixed"]
        anchor = F.when(fixed.rlike(shape), F.regexp_extract(fixed, shape, 2)).otherwise(fixed)
        return F.struct(x["idx"].alias("idx"), x["token"].alias("token"), fixed.alias("token_fixed"), F.replace(anchor, F.lit(" "), F.lit("")).alias("anchor"), anchor.alias("anchor_fixed"))

    # Step by step, as a lambda computes anew whatever it names twice.
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda t: F.length(t) >= least)
    fixes = F.transform(tokens, lambda t, i: F.struct(i.alias("idx"), t.alias("token"), fix(t).alias("token_fixed")))
    spaced = F.filter(fixes, lambda x: (x["token_fixed"] != x["token"]) & (F.replace(x["token_fixed"], F.lit(" "), F.lit("")) == x["token"]))
    found = docs.select("doc_id", "text", F.transform(spaced, finding).alias("found"))
    counts = counts_in_text(F.col("text"), F.transform("found", lambda x: x["anchor"]))
    each = found.select("doc_id", "found", counts.alias("n")).select("doc_id", F.explode(F.arrays_zip("found", "n")).alias("f")).select("doc_id", "f.found.*", "f.n")
    safe = each.groupBy("doc_id", "anchor").agg(F.count(F.lit(1)).alias("fixable"))
    on = (F.col("anchor") == F.col("token")) | (F.col("n") == F.col("fixable"))
    chosen = each.join(safe, ["doc_id", "anchor"]).select("doc_id", "idx", F.when(on, F.col("anchor")).otherwise(F.col("token")).alias("original"), F.when(on, F.col("anchor_fixed")).otherwise(F.col("token_fixed")).alias("corrected"))
    return chosen.groupBy("doc_id", "original").agg(F.min_by("corrected", "idx").alias("corrected"))


def particle_agreement(morphemes: DataFrame) -> DataFrame:
    """A particle that does not agree with the common noun before it, from tagged morphemes."""
    w = Window.partitionBy("doc_id", "word").orderBy("idx")
    m = morphemes.withColumn("noun", F.lag("form").over(w)).withColumn("noun_tag", F.lag("tag").over(w))
    fixed = _agrees(F.col("noun"), F.col("form"))
    return m.where("noun_tag = 'NNG' and tag like 'J%'").select("doc_id", "word", F.concat("noun", "form").alias("original"), F.concat("noun", fixed).alias("corrected")).where("original <> corrected")


def orphan_particle(docs: DataFrame) -> DataFrame:
    """A lone particle after one space is attached to the word before, in the form that agrees."""
    words = docs.select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("i", "w"))
    w = Window.partitionBy("doc_id").orderBy("i")
    x = words.withColumn("before", F.lag("w").over(w)).where(F.col("w").isin("은", "는", "을", "를", "와", "과") & F.col("before").rlike("[가-힣]$"))
    return x.select("doc_id", F.concat_ws(" ", "before", "w").alias("original"), F.concat("before", _agrees(F.col("before"), F.col("w"))).alias("corrected"))


def strip_particle_regex(docs: DataFrame) -> DataFrame:
    """Distinct words and their base form by the particle table, longest particle first."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[가-힣]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.regexp_replace("word", f"^(.+?)({'|'.join(KO_PARTICLES)})\\z", "$1").alias("base"))


def strip_particle_tags(morphemes: DataFrame) -> DataFrame:
    """Base of each word: its morphemes without the trailing run of particles, from tags."""
    down = Window.partitionBy("doc_id", "word").orderBy(F.desc("idx"))
    kept = F.max((~F.col("tag").startswith("J")).cast("int")).over(down) == 1
    base = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("idx", "form")))), lambda x: x["form"]), "")
    return morphemes.withColumn("kept", kept).groupBy("doc_id", "word").agg(base.alias("base"))


def dependent_noun_spacing(morphemes: DataFrame) -> DataFrame:
    """A listed dependent noun that is written together with the adnominal ending before it."""
    w = Window.partitionBy("doc_id", "word").orderBy("idx")
    m = morphemes.withColumn("tag_before", F.lag("tag").over(w)).withColumn("form_before", F.lag("form").over(w))
    return m.where(F.col("form").isin(*DEPENDENT_NOUNS) & (F.col("tag") == "NNB") & (F.col("tag_before") == "ETM")).select("doc_id", "word", F.concat("form_before", "form").alias("original"), F.concat_ws(" ", "form_before", "form").alias("corrected"))


def auxiliary_spacing(morphemes: DataFrame) -> DataFrame:
    """Auxiliary verbs after "-어야": high confidence."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    m = morphemes.withColumn("before", F.lag("form").over(w))
    return m.where("tag = 'VX' and before = '어야'").select("doc_id", "word", "form", F.lit("high").alias("confidence"))


def symbol_noun_spacing(morphemes: DataFrame) -> DataFrame:
    """Words with a noun written together with the closing bracket before it: original, and corrected with spaces.

    Nouns of two letters or more count, and the dependent nouns that stand apart. A bracket of one letter is a label and
    stays; one without an opening bracket in its word counts. Quotation marks are not treated.
    """
    words = morphemes.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list(F.struct("idx", "form", "tag"))).alias("m")).where(F.exists("m", lambda x: x["form"].isin(*CLOSING)))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("spaced"), F.lit(None).cast("string").alias("inside"), F.lit(False).alias("closed"))

    def step(a: Column, x: Column) -> Column:
        noun = (x["tag"].isin("NNG", "NNP", "NR", "NP") & (F.length(x["form"]) >= 2)) | ((x["tag"] == "NNB") & x["form"].isin(*NOUNS_APART))
        opens, closes = x["tag"] == "SSO", x["form"].isin(*CLOSING)
        return F.struct(
            F.concat(a["text"], x["form"]).alias("text"),
            F.concat(a["spaced"], F.when(a["closed"] & noun, " ").otherwise(""), x["form"]).alias("spaced"),
            F.when(opens, "").when(closes, F.lit(None).cast("string")).otherwise(F.concat(a["inside"], x["form"])).alias("inside"),
            (closes & F.coalesce(F.length(F.trim(a["inside"])) > 1, F.lit(True))).alias("closed"),
        )

    done = words.select("doc_id", "word", F.aggregate("m", start, step).alias("a"))
    return done.select("doc_id", "word", F.col("a.text").alias("original"), F.col("a.spaced").alias("corrected")).where("original <> corrected")


def passive_join(docs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Wrongly split passives: two words with one space between them, and both joined.

    ``analyses`` has the tagged parts of joined forms: joined, start, end, form, tag (places of letters, end exclusive).
    They join if a verb crosses the border, or a connecting ending stands before it and the auxiliary of the passive
    after it, and no noun follows the border. Forms that were not analysed are left alone; a null text has no findings.
    """
    words = F.explode(F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))).alias("w")
    each = docs.select("doc_id", words).where("size(w) > 1").select("doc_id", F.explode(F.arrays_zip(F.col("w").alias("a"), F.expr("slice(w, 2, size(w))").alias("b"))).alias("p"))
    each = each.where("p.b is not null and p.a rlike '[아어여]$' and p.b rlike '^[지졌져질진]'").distinct()
    found = each.select("doc_id", F.concat("p.a", "p.b").alias("joined"), F.length("p.a").alias("border"), F.concat_ws(" ", "p.a", "p.b").alias("original"))
    m = found.join(analyses, "joined")
    border, start, end = F.col("border"), F.col("start"), F.col("end")
    crosses = F.col("tag").startswith("V") & (start < border) & (end > border)
    ending = F.col("tag").startswith("E") & F.col("form").isin("아", "어", "여") & (start < border) & (end <= border)
    passive = (F.col("tag") == "VX") & (F.col("form") == "지") & (start <= border) & (end > border)
    noun = F.col("tag").isin("NNG", "NNP", "NNB", "NP", "NR", "SL", "SH", "SN") & (start >= border)
    tested = m.groupBy("doc_id", "original", "joined").agg(F.bool_or(crosses).alias("c"), F.bool_or(ending).alias("e"), F.bool_or(passive).alias("v"), F.bool_or(noun).alias("n"))
    return tested.where("(c or (e and v)) and not n").select("doc_id", "original", F.col("joined").alias("corrected"))


def rule_cards_build(articles: DataFrame, examples: DataFrame, more: str = "더 알아보기", most: int = 600) -> DataFrame:
    """Rule cards of articles (doc_id, prefix, article_no, chapter, section, text) and their examples (doc_id, kind, word).

    The first line is the rule; the rest up to ``more`` is the commentary, of which ``gloss`` keeps ``most`` letters
    and a mark; what follows is ``see_also``. Cards of the same prefix and article get -1, -2, ... by doc_id. A null
    text, chapter or section counts as empty; an article without examples has empty lists.
    """
    text = F.coalesce("text", F.lit(""))
    main = F.substring_index(text, more, 1)
    tidy = lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")
    rest = tidy(F.regexp_replace(main, r"^[^\n]*(\n|\z)", ""))
    heading = F.concat_ws(" ", "chapter", "section")
    category = F.lit("맞춤법")
    for word, name in reversed(RULE_CATEGORIES):
        category = F.when(heading.contains(word), name).otherwise(category)
    seq = F.row_number().over(Window.partitionBy("prefix", "article_no").orderBy("doc_id")) - 1
    words = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("word")))).alias(kind)
    by = examples.groupBy("doc_id").agg(words("right"), words("wrong"))
    none = F.array().cast("array<string>")
    ids = articles.select("doc_id", "prefix", "article_no", seq.alias("seq"))  # numbers need no texts
    cards = articles.drop("prefix", "article_no").join(ids, "doc_id").join(by, "doc_id", "left")
    number = F.concat("prefix", F.lit("-"), F.lpad(F.col("article_no").cast("string"), 4, "0"), F.when(F.col("seq") > 0, F.concat(F.lit("-"), F.col("seq").cast("string"))).otherwise(""))
    return cards.select(
        "doc_id", number.alias("rule_id"), "article_no", tidy(F.substring_index(main, "\n", 1)).alias("rule_text"), F.when(F.length(rest) <= most, rest).otherwise(F.concat(F.substring(rest, 1, most), F.lit("…"))).alias("gloss"),
        F.when(text.contains(more), tidy(F.expr(f"substring(coalesce(text, ''), locate('{more}', coalesce(text, '')) + {len(more)})"))).otherwise("").alias("see_also"),
        category.alias("category"), F.coalesce("right", none).alias("correct"), F.coalesce("wrong", none).alias("incorrect"),
    )


def suspicious_cards(cards: DataFrame) -> DataFrame:
    """Cards whose rule is shorter than 5 or longer than 200 letters, or that have no example."""
    n = F.length("rule_text")
    return cards.where((n < 5) | (n > 200) | ((F.size("correct") == 0) & (F.size("incorrect") == 0)))


def nominal_boundary(morphemes: DataFrame) -> DataFrame:
    """By word: whether it is made of nouns and particles only."""
    return morphemes.groupBy("doc_id", "word").agg(F.bool_and(F.col("tag").startswith("N") | F.col("tag").startswith("J")).alias("nominal"))


def known_form(morphemes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """By word: whether every content morpheme is in the lexicon."""
    content = morphemes.where("(tag like 'N%' and length(form) >= 2) or tag like 'V%'")
    return content.join(lexicon.select(F.col("word").alias("form"), F.lit(True).alias("hit")), "form", "left").groupBy("doc_id", "word").agg(F.bool_and(F.col("hit").isNotNull()).alias("known"))


def bracket_balance(docs: DataFrame) -> DataFrame:
    """By document and kind: opening and closing brackets, their difference, and the deepest nesting.

    Depth is a fold over the brackets of a row.
    """
    n = lambda ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit("")))
    rows = []
    for kind, a, b in (("round", "(", ")"), ("square", "[", "]"), ("curly", "{", "}")):
        chars = F.split(F.regexp_replace("text", f"[^\\{a}\\{b}]", ""), "")
        depth = F.aggregate(chars, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda s, c: F.struct((s["d"] + F.when(c == a, 1).when(c == b, -1).otherwise(0)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c == a, 1).otherwise(0)).alias("m")), lambda s: s["m"])  # noqa: B023
        rows.append(F.struct(F.lit(kind).alias("kind"), n(a).alias("opened"), n(b).alias("closed"), F.abs(n(a) - n(b)).alias("imbalance"), depth.alias("depth")))
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("b")).select("doc_id", "b.*").where("opened + closed > 0")


def finding_collect(findings: DataFrame) -> DataFrame:
    """The first finding of a document and original, in order of stage."""
    return findings.groupBy("doc_id", "original").agg(F.min_by(F.struct("rule", "corrected"), F.struct("stage", "corrected")).alias("f")).select("doc_id", "original", "f.*")


def _without_two(word: Column) -> Column:
    """``word`` and what is left of it without one or two of its characters, once each."""
    n = F.length(word)
    at = F.sequence(F.lit(1), n)
    less = lambda text, i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))
    one = F.array_distinct(F.transform(at, lambda i: less(word, i)))
    two = F.transform(one, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: less(w, i)))
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(two)))


def _parts(word: Column, length: Column) -> Column:
    """Where a word of ``length`` is cut in three: array of struct(part, at, size), the later parts the longer ones."""
    size = F.floor(length / 3).cast("int")
    second = F.when(length % 3 == 2, size + 1).otherwise(size)
    part = lambda n, at, width: F.struct(F.lit(n).alias("part"), at.cast("int").alias("at"), width.cast("int").alias("size"))
    return F.array(part(0, F.lit(1), size), part(1, size + 1, second), part(2, size + second + 1, length - size - second))


def term_similarity(terms: DataFrame, least: int = 5, short: int = 12) -> DataFrame:
    """All pairs of terms (``least`` characters or more) within two edits: word, other, distance, letters.

    ``letters`` is their distance in decomposed letters. Two words within two edits share what is left of them without
    at most two characters each: words up to ``short`` characters, and those up to two longer, meet on that. Of two
    longer ones, the shorter is cut in three, and one part stands in the other as it is, moved by at most two
    places: they meet on length, part and its text. Both are equi-joins on keys in proportion to the terms; distances are
    counted once a pair. Null terms are left out, repeated ones are one.
    """
    t = terms.select("word").distinct().withColumn("n", F.length("word")).where(F.col("n") >= least)
    left = t.where(F.col("n") <= short + 2).select("word", "n", F.explode(_without_two(F.col("word"))).alias("key"))
    other = left.select(F.col("word").alias("other"), F.col("n").alias("m"), "key")
    near = left.join(other, "key").where((F.col("word") < F.col("other")) & (F.least("n", "m") <= short)).select("word", "other")

    long = t.where(F.col("n") > short)
    cut = lambda p: F.substring(F.col("word"), p["at"], p["size"])
    index = long.select("word", F.explode(F.transform(_parts(F.col("word"), F.col("n")), lambda p: F.struct(F.col("n").alias("length"), p["part"].alias("part"), cut(p).alias("text")))).alias("k")).select("word", "k.*")
    lengths = F.filter(F.array(F.col("n"), F.col("n") - 1, F.col("n") - 2), lambda m: m > short)
    moved = lambda m, p: F.transform(F.filter(F.array(*[p["at"] + d for d in range(-2, 3)]), lambda a: (a >= 1) & (a + p["size"] - 1 <= F.col("n"))), lambda a: F.struct(m.alias("length"), p["part"].alias("part"), F.substring(F.col("word"), a, p["size"]).alias("text")))
    asks = F.array_distinct(F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(_parts(F.col("word"), m), lambda p: moved(m, p))))))
    probe = long.select(F.col("word").alias("other"), F.explode(asks).alias("k")).select("other", "k.*")
    far = index.join(probe, ["length", "part", "text"]).where("word <> other").select(F.least("word", "other").alias("word"), F.greatest("word", "other").alias("other"))
    both = near.unionByName(far).distinct().withColumn("distance", F.levenshtein("word", "other", 2)).where("distance >= 0")
    return both.withColumn("letters", letter_distance(F.col("word"), F.col("other")))
