"""Test inputs for the registered queries: driver tables with a deterministic overlay.

The driver's prose holds none of the domain's terms, so a query on it alone would be empty. The
overlay adds one of twelve snippets of ours to each document, and gives it a title and a URL, by
doc_id; it gives pages URLs of every kind and links between them. The SQL checks use
the same literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FULL = (
    "Malaria is an infection carried by mosquitoes, and the disease begins with chills. Common symptoms are fever, headache and fatigue that come and go. Some people feel nausea - and vomiting: often at night. "
    "Treatment depends on the type of parasite and on the age of the patient.\n\n"
    "To prevent malaria, sleep under a net and avoid stagnant water near the house. Prevention also means to wash and cover water tanks. The cause is a parasite that spreads by bites. "
    "Drink fluids and rest at home while you wait for the doctor. Seek medical care at once if there is confusion or a severe headache. A light diet and regular sleep help the patient to recover."
)
SNIPPETS = (
    _FULL,
    "Asthma is a chronic disease of the airways and its causes are not fully known. Symptoms are cough and short breath, mostly at night. Go to a hospital if breath gets worse, it is an emergency. Treatment with medicine helps most patients to live as they like.",
    "Join our campaign and donate today! The symptoms of the disease can be treated, and your donation pays for treatment, prevention and care of patients in every hospital of the country.",
    "Good management of a day makes life easier, and a plan for the week is worth the time that it takes. Most people find that lists help them to see what comes next and what can wait for later.",
    "मलेरिया एक संक्रमण है जो मच्छरों से फैलता है और इसके लक्षण बुखार और सिरदर्द हैं। symptom treatment malaria fever care prevention मरीज को आराम करना चाहिए और पानी पीना चाहिए, और डॉक्टर से सलाह लेनी चाहिए ताकि बीमारी जल्दी ठीक हो जाए।",
    _FULL.upper().replace(". ", ".   "),
    "Influenza symptoms start all of a sudden and the list of what people report is long because fever, cough, pain in the limbs, headache, sore throat, weakness and fatigue may come together or one after the other over several days, and because the infection is felt in the whole body by children and the elderly alike, so that treatment begins with rest. To prevent influenza, wash hands. Seek care if breath is short. Avoid crowds, and protect others with a mask.",
    "Diabetes is a disorder of blood sugar and its symptoms include weakness and thirst; prevention starts with diet and exercise\n\nSeek the advice of those who know the disease well, since treatment of diabetes needs care every day of the week and a doctor who can look at the causes",
    "Tuberculosis is an infection of the lungs. The symptoms are cough​ and fever for weeks. The treatment takes months of medicine.  Prevention is by vaccine and by screening. Danger signs need a doctor, so seek care early in the disease.",
    "Covid symptoms vary. " + " ".join(f"Symptom number {w} is a cough or pain of another kind." for w in (
        "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"
    )) + " Wash hands to prevent the disease. See a doctor if it is severe, and rest. The cause is a virus.",
    "Hypertension has few symptoms. Severe headache and chest pain are a warning, and an emergency with confusion is a danger. Prevent it with exercise and less stress. Take medicine as the doctor says. Causes of the disease are many and treatment is for life. Warning: seek medical help for severe pain.",
    "",
)
TITLES = (
    "Malaria", "What is asthma?", "Donate", "Plans that work: how networks help", "Malaria - मलेरिया", "MALARIA  ",
    "Influenza in winter", "",
    "Tuberculosis: a very long title that goes on and on until it passes the limit of one hundred and forty characters, and then some more words follow it",
    "Health notes", "Hypertension explained", "Lungs and airways", "Notes"
)
URLS = (
    "https://www.who.int/malaria/overview", "https://medlineplus.gov/asthma.html", "https://example.org/donate",
    "https://notwho.int/plans", "https://www.nhs.uk/conditions/malaria", "https://cdc.gov/malaria/prevention",
    "https://health.state.gov.uk/influenza", "https://www.nih.gov/diabetes?x=1", "https://mohfw.gov.in/tb",
    "https://example.com/covid-19", "https://pages.example.net/hypertension/about", "https://example.com:8080/lungs",
    "https://example.com/", "https://health.gov/asthma/news/today", "https://example.com/tuberculosis?topic=shop",
    "https://cdc.gov/covid/blood-pressure"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(key: str, values: tuple[str, ...]) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(F.col(key) % len(values) == i, F.lit(values[i])).otherwise(out)
    return out


def pick_sql(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, src (the driver's source), raw (the driver's text), text, title, source_url."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat("text", F.lit("\n\n"), pick("doc_id", SNIPPETS))
    return docs.select(
        "doc_id", F.col("source").alias("src"), F.col("text").alias("raw"), text.alias("text"),
        pick("doc_id", TITLES).alias("title"), pick("doc_id", URLS).alias("source_url")
    )


DOCUMENTS_SQL = f"o AS (SELECT doc_id, source AS src, text AS raw, text || chr(10) || chr(10) || {pick_sql('doc_id', SNIPPETS)} AS text, {pick_sql('doc_id', TITLES)} AS title, {pick_sql('doc_id', URLS)} AS source_url FROM documents)"

def page_html(links: Column = None) -> Column:
    """A page's HTML with a snippet as its last paragraphs, and these links; its own links are none any more."""
    snippet = F.regexp_replace(pick("page_id", SNIPPETS), "\n\n", "</p><p>")
    end = [F.lit("<p>"), snippet, F.lit("</p>"), *([] if links is None else [links]), F.lit("</article>")]
    return F.replace(F.replace(F.col("html"), F.lit('href="'), F.lit('data-was="')), F.lit("</article>"), F.concat(*end))


PAGE_SQL = f"replace(replace(html, 'href=\"', 'data-was=\"'), '</article>', '<p>' || replace({pick_sql('page_id', SNIPPETS)}, chr(10) || chr(10), '</p><p>') || '</p></article>')"

#: Turns a page's URL into one of every kind.
KINDS = 12


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, given: the URL as somebody might write it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    u = F.col("url")
    forms = [
        u, F.concat(F.lit("  "), F.upper(u), F.lit("#Top ")), F.concat(F.regexp_replace(u, r"\?.*", ""), F.lit("//")),
        F.concat(F.regexp_replace(u, r"\?.*", ""), F.lit(";v=1?q=a+b")), F.regexp_replace(u, "^https?://", ""),
        F.concat(F.regexp_replace(u, r"\?.*", ""), F.lit("/events/prevention")),
        F.concat(F.regexp_replace(u, r"\?.*", ""), F.lit("/Report.PDF")), F.lit(""), F.regexp_replace(u, "://", "://www."),
        F.concat(F.regexp_replace(u, r"\?.*", ""), F.lit("?topic=news&x=%6Aobs")),
        F.regexp_replace(u, r"^([a-z]+://[^/]*).*", "$1"), F.concat(F.regexp_replace(u, r"\?.*", ""), F.lit("/a|b c"))
    ]
    out = forms[-1]
    for i in range(KINDS - 2, -1, -1):
        out = F.when(F.col("page_id") % KINDS == i, forms[i]).otherwise(out)
    return pages.select("page_id", "url", out.alias("given"))


_BARE = r"regexp_replace(url, '\?.*', '')"
_FORMS = (
    "url", "'  ' || upper(url) || '#Top '", f"{_BARE} || '//'", f"{_BARE} || ';v=1?q=a+b'",
    "regexp_replace(url, '^https?://', '')", f"{_BARE} || '/events/prevention'", f"{_BARE} || '/Report.PDF'", "''",
    "regexp_replace(url, '://', '://www.')", f"{_BARE} || '?topic=news&x=%6Aobs'",
    r"regexp_replace(url, '^([a-z]+://[^/]*).*', '\1')", f"{_BARE} || '/a|b c'"
)
PAGE_URLS_SQL = f"u AS (SELECT page_id, url, CASE page_id % {KINDS} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END AS given FROM pages)"
