"""Column lists and Spark types of the posting relation."""

from __future__ import annotations

# The twelve export columns in file order, then the metadata columns.
EXPORT_COLUMNS = (
    "title", "company", "location", "description", "salary", "experience_raw",
    "max_experience_required", "url", "posted_date", "job_type", "source", "scraped_at",
)
METADATA_COLUMNS = ("salary_min", "salary_max", "tags", "job_id", "company_logo")

# Raw columns an adapter hands over, before validation.
RAW_TYPES = {
    "title": "string",
    "company": "string",
    "source": "string",
    "url": "string",
    "location": "string",
    "description": "string",
    "job_type": "string",
    "salary": "string",
    "salary_raw": "string",
    "salary_min": "string",
    "salary_max": "string",
    "experience_raw": "string",
    "max_experience_required": "bigint",
    "tags": "array<string>",
    "posted_date": "string",
    "company_logo": "string",
    "scraped_at": "string",
    "job_id": "string",
}
# Position of a posting: source first, then page, then place on the page. "First
# wins" always means smallest by these columns; they come from the data, never from
# partition numbering, so a re-run task gives the same answer.
ORDER_COLUMNS = ("source_rank", "page_id", "ord")

EXPORT_DDL = ", ".join(f"{name} string" for name in EXPORT_COLUMNS)
EXPORT_TYPED_DDL = ", ".join(
    f"{name} {'bigint' if name == 'max_experience_required' else 'string'}" for name in EXPORT_COLUMNS
)

FEED_ITEM_DDL = (
    "slug string, id string, epoch string, date string, company string, company_logo string, "
    "position string, tags array<string>, description string, location string, apply_url string, "
    "salary_min string, salary_max string, logo string, url string, legal string"
)
API_ITEM_DDL = (
    "title string, companyName string, jobDescription string, jdURL string, staticUrl string, "
    "jobId string, createdDate string, salary string, experience string, "
    "placeholders array<struct<type string, label string, value string, text string>>"
)

# The known boards in collection order.
SOURCES = ("naukri", "remoteok", "wellfound")
