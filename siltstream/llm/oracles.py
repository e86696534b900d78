"""SQL for those pN_ queries that DuckDB can answer over whole tables."""

from __future__ import annotations

import sys
import unicodedata

# The rule of problem 9 once more, from the Unicode data where they tell, and not from the operator's tables.
# Letters drawn like a Latin one, and beneath each the Latin one.
SHAPES = (
    "аеорсухіѕјһԁԛԝАВЕКМНОРСТХУІЅЈԚԜёЁїЇѐЀ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονόϳΆΈΊΌΎΪΫαιρυϲϹͿάίύϊϋ" "ցհզոսօՕՍՏ" "ᎠᎡᎢᎪᎫᎬᏃᎳᎷᎻᏀᏙᏚᏞᏟᏢᏦᏴ",
    "aeopcyxisjhdqwABEKMHOPCTXYISJQWëËïÏèÈ" "ABEZHIKMNOPTYXovójÁÉÍÓÝÏŸaipucCJáíúïü" "ghqnuoOUS" "DRTAJEZWMHGVSLCPKB",
)
# Format characters that are seen: signs over numbers, and Egyptian and musical marks.
SEEN = set(range(0x600, 0x606)) | {0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD} | set(range(0x13430, 0x13440)) | set(range(0x1D173, 0x1D17B)) | set(range(0x1BCA0, 0x1BCA4))
# Marks and letters without a shape that are no format characters.
SHAPELESS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0xE0020, 0xE0080)) | set(range(0xE0100, 0xE01F0))


def form_sql(column: str) -> str:
    """The DuckDB expression of problem 9's one form."""
    unseen, plain, joined = [], dict(zip(*SHAPES)), {}
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c)
        if (kind == "Cf" and code not in SEEN) or code in SHAPELESS:
            unseen.append(c)
        elif kind == "Zs":
            plain[c] = " "
        elif parts.startswith(("<wide>", "<narrow>")):
            plain[c] = chr(int(parts.split()[1], 16))
        elif "LATIN" in unicodedata.name(c, "") and ("LIGATURE" in unicodedata.name(c) or code in range(0x1C4, 0x1CD)) and parts and len(unicodedata.normalize("NFKC", c)) > 1:
            # Of the digraphs, those with a capital and a small letter are a matter of case that is seen.
            if unicodedata.category(c) != "Lt":
                joined[c] = unicodedata.normalize("NFKC", c)
    text = f"regexp_replace({column}, '[{''.join(unseen)}]', '', 'g')"
    for c, letters in joined.items():
        text = f"replace({text}, '{c}', '{letters}')"
    return f"nfc_normalize(translate({text}, '{''.join(plain)}', '{''.join(plain.values()).replace(chr(39), chr(39) * 2)}'))"


# Keys of problem 6 without the differences in which they are written.
SITE = r"nullif(regexp_replace(lower(trim({0})), '^www\.', ''), '')"
NAME = r"nullif(regexp_replace(regexp_replace(lower(trim({0})), '[\s\-_.]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_CODE = "regexp_extract(lower(trim({0})), '^[^-_]*')"
LANG = (
    f"nullif(CASE {_CODE} WHEN 'eng' THEN 'en' WHEN 'english' THEN 'en' WHEN 'spa' THEN 'es' WHEN 'español' THEN 'es' WHEN 'spanish' THEN 'es' "
    "WHEN 'fra' THEN 'fr' WHEN 'fre' THEN 'fr' WHEN 'français' THEN 'fr' WHEN 'french' THEN 'fr' WHEN 'deu' THEN 'de' WHEN 'ger' THEN 'de' WHEN 'deutsch' THEN 'de' WHEN 'german' THEN 'de' "
    f"WHEN 'ita' THEN 'it' WHEN 'por' THEN 'pt' WHEN 'nld' THEN 'nl' WHEN 'dut' THEN 'nl' ELSE {_CODE} END, '')"
)

REPEATED_LINES = r"""
    WITH s AS (SELECT item_id, content, CASE WHEN starts_with(lower(domain), 'www.') THEN substr(lower(domain), 5) ELSE lower(domain) END AS site FROM scraped_items WHERE domain IS NOT NULL),
    l AS (SELECT item_id, site, line_no, regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS key
        FROM (SELECT item_id, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM s)),
    t AS (SELECT site, count(*) AS total FROM s GROUP BY site),
    k AS (SELECT site, key, count(DISTINCT item_id) AS n FROM l WHERE key <> '' GROUP BY ALL),
    found AS (SELECT l.item_id, l.line_no FROM l JOIN k USING (site, key) JOIN t USING (site) WHERE k.n >= 5 AND k.n >= 0.15 * t.total)
"""


def oracle_sql() -> dict[str, str]:
    form = form_sql("text")
    # Tags, targets of links and named characters stand between words.
    markup = r"<[/]?[A-Za-z][^<>\n]*>|\]\([^()\s]*\)|&[A-Za-z]{2,31};"
    return {
        "p3_found": """
            SELECT i.item_id FROM scraped_items i JOIN split_limits l
            ON l.content_type = CASE WHEN i.content_type IN (SELECT content_type FROM split_limits) THEN i.content_type ELSE 'text' END
            WHERE CASE WHEN l.size_unit = 'bytes' THEN strlen(i.content) ELSE length(i.content) END > l.max_size""",
        "p3_joined": """
            SELECT i.item_id, md5(i.content) AS digest, true AS within FROM scraped_items i JOIN split_limits l
            ON l.content_type = CASE WHEN i.content_type IN (SELECT content_type FROM split_limits) THEN i.content_type ELSE 'text' END
            WHERE CASE WHEN l.size_unit = 'bytes' THEN strlen(i.content) ELSE length(i.content) END > l.max_size""",
        "p5_found": REPEATED_LINES + "SELECT item_id, line_no FROM found",
        "p5_cleaned": REPEATED_LINES + """, g AS (SELECT item_id, list(line_no) AS gone FROM found GROUP BY item_id)
            SELECT i.item_id, CASE WHEN gone IS NULL THEN content
                ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda line, n: NOT list_contains(gone, n)), chr(10)) END AS cleaned,
                CAST(coalesce(len(gone), 0) AS INTEGER) AS lines_cut
            FROM scraped_items i LEFT JOIN g USING (item_id)""",
        "p4_members": r"""
            WITH w AS (SELECT item_id, md5(content) AS key FROM scraped_items WHERE len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) >= 60)
            SELECT item_id, min(item_id) OVER (PARTITION BY key) AS representative FROM w""",
        "p6_counts": rf"""
            WITH k AS (SELECT 'documents' AS origin, {NAME.format("source")} AS source, {LANG.format("lang")} AS lang, {SITE.format("domain")} AS domain, nullif(text, '') AS text FROM documents
                UNION ALL SELECT 'scraped_items', NULL, NULL, {SITE.format("domain")}, nullif(content, '') FROM scraped_items)
            SELECT origin, source, lang, domain, count(*) AS documents, count(DISTINCT md5(text)) AS distinct_texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS characters
            FROM k GROUP BY ALL""",
        "p7_whole": """
            SELECT spec_name, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS cut_in_vain, CAST(0 AS BIGINT) AS over_capacity FROM pack_specs""",
        "p8_spans": rf"""
            WITH d AS (SELECT doc_id AS id, {form} AS text FROM documents), e AS (SELECT eval_id AS id, {form} AS text FROM eval_items),
            dw AS (SELECT id, regexp_extract_all(lower(regexp_replace(text, '{markup}', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM d),
            ew AS (SELECT id, regexp_extract_all(lower(regexp_replace(text, '{markup}', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM e),
            dp AS (SELECT id, unnest(range(0, len(w) - 11)) AS first, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS phrase FROM dw WHERE len(w) >= 12),
            ep AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS phrase FROM ew WHERE len(w) >= 12),
            h AS (SELECT DISTINCT dp.id AS doc_id, ep.id AS eval_id, dp.first FROM dp JOIN ep USING (phrase)),
            n AS (SELECT *, CASE WHEN first - lag(first) OVER (PARTITION BY doc_id, eval_id ORDER BY first) <= 12 THEN 0 ELSE 1 END AS opens FROM h),
            r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, eval_id ORDER BY first) AS run FROM n)
            SELECT doc_id, eval_id, min(first) AS first_word, max(first) + 11 AS last_word FROM r GROUP BY doc_id, eval_id, run""",
        "p8_found": rf"""
            WITH d AS (SELECT doc_id AS id, {form} AS text FROM documents), e AS (SELECT eval_id AS id, {form} AS text FROM eval_items),
            dw AS (SELECT id, regexp_extract_all(lower(regexp_replace(text, '{markup}', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM d),
            ew AS (SELECT id, regexp_extract_all(lower(regexp_replace(text, '{markup}', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w FROM e),
            dp AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS phrase FROM dw WHERE len(w) >= 12),
            ep AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS phrase FROM ew WHERE len(w) >= 12)
            SELECT DISTINCT dp.id AS doc_id, ep.id AS eval_id FROM dp JOIN ep USING (phrase)""",
        "p9_texts": f"SELECT doc_id, {form} AS canonical, {form} <> text AS changed FROM documents",
        "p9_found": f"""
            WITH k AS (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL)
            SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.form = b.form
            WHERE a.doc_id < b.doc_id AND a.text <> b.text""",
    }
