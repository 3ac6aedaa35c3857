"""Word lists, lookup tables, constants and patterns that results rest on."""

# Dates after this one are flagged as lying in the future.
AS_OF = "2026-08-12"
HOURS_PER_MONTH = 160

TITLES = ("mr", "mrs", "ms", "dr", "shri", "smt")

EMAIL_PATTERN = "^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"
RATE_PATTERN = "^([\\d.]+)(k?)/(hr|hour|month|mo)$"

CITIES = {
    "bengaluru": "Bengaluru",
    "bangalore": "Bengaluru",
    "blr": "Bengaluru",
    "gurgaon": "Gurugram",
    "gurugram": "Gurugram",
    "delhi": "Delhi",
    "new delhi": "Delhi",
    "delhi ncr": "Delhi",
    "ncr": "Delhi",
    "noida": "Noida",
    "pune": "Pune",
}

STATUSES = ("active", "inactive", "paused")
TRUE_WORDS = ("y", "yes", "true", "1")
FALSE_WORDS = ("n", "no", "false", "0")

SKILLS = {
    "n8n": "n8n",
    "langchain": "LangChain",
    "rest apis": "REST APIs",
    "rest api": "REST APIs",
    "mongodb": "MongoDB",
    "sql": "SQL",
    "mysql": "MySQL",
    "docker": "Docker",
    "zapier": "Zapier",
    "javascript": "JavaScript",
    "react": "React",
    "python": "Python",
    "selenium": "Selenium",
    "web scraping": "Web Scraping",
    "fastapi": "FastAPI",
    "pandas": "Pandas",
}

# Annual pay below LAKHS_BELOW is in lakhs; plausible pay lies in PAY_RANGE.
LAKHS_BELOW, LAKH = 1000, 100_000
PAY_RANGE = (100_000, 10_000_000)
RATE_CONFLICT_ABOVE = 150_000
EXPERIENCE_RANGE = (0, 50)

NAME_SIMILARITY = 88
CONFIDENCE = {"email": 1.0, "phone": 0.99, "name_city": 0.80}
CHECK_CONFIDENCE = {"email": 1.0, "phone": 0.99, "name": 0.5}
SOURCE_PRIORITY = ("source1", "source3", "source2")
OWNED_FIELDS = {
    "source1": ("experience_years", "current_ctc_inr", "ctc_source_unit", "applied_date"),
    "source2": ("gig_rate_inr_hour", "gig_rate_inr_month", "gig_rate_unit", "gig_status"),
    "source3": ("contact_verified", "projects_completed"),
}

CATEGORIES = ("automation-heavy", "web-dev", "data", "generalist")
CATEGORY_WORDS = {
    "automation-heavy": ("n8n", "zapier", "langchain", "make", "selenium", "web scraping"),
    "web-dev": ("react", "javascript", "fastapi", "rest apis", "docker"),
    "data": ("sql", "mysql", "mongodb", "pandas"),
}
SHARE_FLOOR, FLOW_CONFIDENCE, BATCH_LIMIT = 0.45, 0.6, 25

EPSILON = 1e-12
SAMPLE_RATE, FRAME_SECONDS, CLIP_AT, SILENCE_DB = 16_000, 0.03, 0.999, -30.0
UPLOAD_BYTES = 25 * 1024 * 1024
UPLOAD_SUFFIXES = ("wav", "webm", "ogg", "oga", "mp3", "m4a", "mp4", "flac", "aac", "opus")
