"""Writers: texts, subtitles, documents of JSON, tables, logs and reports."""
