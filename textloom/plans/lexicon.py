"""What the engine looks for: term lists and thresholds, all parameters with the default domain below."""

from __future__ import annotations

from dataclasses import dataclass

# The default domain's terms, matched as substrings of folded text.
REQUIRED = ("symptom", "symptoms", "treatment", "diagnosis", "management", "prevention", "prevent", "cause", "causes")
CONDITION = ("disease", "disorder", "syndrome", "infection", "covid", "influenza", "diabetes", "cancer", "tuberculosis", "malaria", "hypertension", "asthma")
CONTEXT = (
    "disease", "infection", "health", "medical", "doctor", "patient", "diagnosis", "fever", "cough", "pain", "vaccine",
    "medicine", "clinic", "hospital", "care", "virus", "bacteria", "chronic", "acute", "therapy", "guideline",
    "public health"
)
EXCLUDED = (
    "campaign", "fundraising", "donate", "donation", "sponsor", "petition", "election", "merchandise", "shop now",
    "subscribe now", "all rights reserved", "newsletter", "media contact", "press release", "about us", "careers",
    "job openings", "section 508", "disclaimer", "trademark", "terms of use", "accessibility statement"
)
URL_SUBSTRINGS = (
    "campaign", "campaigns", "donate", "donation", "fundraising", "event", "events", "press", "newsroom", "media",
    "careers", "jobs", "privacy", "cookie", "terms", "contact", "about", "partner", "sponsor", "shop"
)
URL_SEGMENTS = (
    "campaign", "campaigns", "donate", "donation", "fundraising", "event", "events", "press", "news", "newsroom",
    "news-room", "media", "media-centre", "multimedia", "podcast", "video", "videos", "careers", "jobs", "privacy",
    "cookie", "cookies", "terms", "contact", "about", "shop", "store", "other", "accessibility", "agencymaterials",
    "agency-materials", "legal", "disclaimer"
)
GENERIC_TITLES = ("what is", "what are", "how ", "can we", "can you", "world's", "worlds", "article", "explained", "works", "method", "study", "report")
SYMPTOMS = ("symptom", "fever", "cough", "pain", "rash", "fatigue", "nausea", "vomiting", "diarrhea", "breath", "headache", "sore throat", "weakness")
PREVENTION = ("prevent", "prevention", "avoid", "vaccin", "wash", "hygiene", "mask", "screening", "protect", "sanitation")
WARNING = ("warning", "danger", "emergency", "severe", "seek medical", "seek care", "doctor", "hospital", "chest pain", "confusion")
HOME_CARE = ("home care", "self care", "self-care", "rest", "fluids", "drink", "hydration", "isolate", "medicine", "treatment")
WARNING_CONTEXT = ("warning", "danger", "emergency", "severe", "seek medical", "seek care")
LIFESTYLE = ("sleep", "exercise", "diet", "hydration", "stress", "avoid smoking", "avoid alcohol")
QUESTIONS = ("Do you have high fever (>102°F)?", "Are you experiencing body pain?", "Since how many days do you have symptoms?")
RISK_GROUPS = ("children", "pregnant women", "elderly")
CONFUSIONS = ("Common cold", "Flu", "COVID-19")
MILD_CONDITIONS = ("No severe warning signs", "Mild and stable symptoms")
MODERATE_CONDITIONS = ("Symptoms persist beyond a few days", "Symptoms interfere with daily activities")
SEVERE_CONDITIONS = ("Any emergency warning sign",)
MILD_ADVICE = ("Monitor symptoms and continue basic supportive care",)
MODERATE_ADVICE = ("Consult a doctor soon for clinical evaluation", "Monitor progression closely and avoid self-medication escalation")
SEVERE_ADVICE = ("Seek immediate medical care", "Visit the nearest emergency facility without delay")

# Markup that holds no text of the page, and paths that hold no page.
REMOVED_TAGS = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button", "iframe", "svg", "canvas", "figure", "figcaption")
REMOVED_CLASSES = ("advertisement", "ads", "cookie", "breadcrumb", "social", "share", "menu")
NON_PAGE_EXTENSIONS = (
    "7z", "avi", "css", "csv", "doc", "docx", "gif", "gz", "jpeg", "jpg", "js", "json", "mov", "mp3", "mp4", "pdf", "png",
    "ppt", "pptx", "rar", "svg", "tar", "webp", "xls", "xlsx", "xml", "zip"
)

# Host endings in order of precedence, with label, source name and tag.
SOURCES = (
    (("who.int",), "WHO", "World Health Organization", "WHO verified"),
    (("medlineplus.gov", "medlineplus.org"), "MedlinePlus", "MedlinePlus", "MedlinePlus verified"),
    (("cdc.gov",), "CDC", "Centers for Disease Control and Prevention", "CDC verified"),
    (("nih.gov",), "NIH", "National Institutes of Health", "NIH verified"),
    (("nhs.uk",), "NHS", "National Health Service", "NHS verified"),
    (("gov.in",), "Government of India", "Government of India", "Govt verified"),
    ((".gov",), "Government health source", "Government health source", "Govt verified"),
)

# Texts and limits of records, exports and crawls.
UNTITLED_PAGE = "Untitled medical page"
UNTITLED_ENTRY = "Untitled medical dataset entry"
CATEGORY = "disease"
EXPORT_FIELDS = (
    "title", "category", "symptoms", "common_symptoms", "rare_symptoms", "description", "differential_questions",
    "severity_levels", "home_care", "lifestyle_tips", "warning_signs", "when_to_seek_doctor", "prevention", "risk_groups",
    "possible_confusions", "confidence_rules", "source", "verified", "verified_from", "source_url"
)
LIST_FIELDS = (
    "symptoms", "common_symptoms", "rare_symptoms", "differential_questions", "home_care", "lifestyle_tips",
    "warning_signs", "prevention", "risk_groups", "possible_confusions"
)
FINGERPRINT_TEXTS = ("title", "source_url", "description")
FINGERPRINT_LISTS = ("symptoms", "common_symptoms", "rare_symptoms", "warning_signs", "prevention", "home_care", "lifestyle_tips", "risk_groups")
WORKERS_PER_PLATFORM = 3
UPLOAD_LIMIT = 12 * 1024 * 1024
RATE_LIMITED = "Completed with 0 records. Some platforms were rate-limited (HTTP 429), but crawl continued across all provided platforms."
NOT_FETCHED = "Completed with 0 records. Some platforms could not be fetched, and others had no accepted medical pages."
NONE_PASSED = "Completed with 0 records. No pages passed the medical relevance filters across the provided platforms."


@dataclass(frozen=True)
class Lexicon:
    """The domain. Every operator that matches terms takes one; the defaults are the lists above."""

    required: tuple[str, ...] = REQUIRED
    condition: tuple[str, ...] = CONDITION
    context: tuple[str, ...] = CONTEXT
    excluded: tuple[str, ...] = EXCLUDED
    url_substrings: tuple[str, ...] = URL_SUBSTRINGS
    url_segments: tuple[str, ...] = URL_SEGMENTS
    generic_titles: tuple[str, ...] = GENERIC_TITLES
    symptoms: tuple[str, ...] = SYMPTOMS
    prevention: tuple[str, ...] = PREVENTION
    warning: tuple[str, ...] = WARNING
    home_care: tuple[str, ...] = HOME_CARE
    warning_context: tuple[str, ...] = WARNING_CONTEXT
    lifestyle: tuple[str, ...] = LIFESTYLE
    min_block: int = 100
    sentence_limit: int = 8
    item_length: int = 280
    description_blocks: int = 3
    description_length: int = 1200
    title_length: int = 140

    def sentence_classes(self) -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
        """Of each list in a record: terms, and terms that exclude a sentence from it."""
        return {
            "symptoms": (self.symptoms, self.warning_context), "prevention": (self.prevention, ()),
            "warning_signs": (self.warning, ()), "home_care": (self.home_care, ()), "lifestyle_tips": (self.lifestyle, ())
        }


DEFAULT = Lexicon()
