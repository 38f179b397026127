"""Schemas of the logical tables."""

SCORES = "symbol string, filing_date date, document_score double, mean_chunk_score double, median_chunk_score double, num_chunks long, filename string, edinet_code string, status string"
LEXICON = "symbol string, filing_date date, pos_rate double, neg_rate double, lmmd_net double, token_count long, pos_count long, neg_count long, filename string, edinet_code string, status string"
PRICES = "date date, trading_date date, symbol string, close double, adj_close double"
PARAMETERS = "Ticker string, alpha double, beta double"
ABNORMAL = "event_id long, Ticker string, EventDate date, Sentiment double, window_start int, window_end int, CAR double"
SUMMARY = "sentiment_col string, window_start int, window_end int, nobs long, beta double, se_cluster double, p_value double, r2 double"
CONSTITUENTS = "code string, symbol string, company_ja string, name_ja string, sector_sub string, asof_date date"
SECTIONS = "Industry string, Code string, `Company Name` string"
#: A chunk's score is read as a string, since some files hold numbers in quotes.
ANALYSIS = "mdna_found boolean, document_score double, chunks array<struct<score: string, label: string, evidence: array<string>>>"
DATA_FILES = ("File", "edinet_code", "fiscal_year", "fiscal_month", "fiscal_period_kind", "company_name", "company_name_en", "FileName")
