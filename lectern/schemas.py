"""Schemas of the entities, as Spark DDL."""

SEGMENT = "struct<start:double,end:double,text:string>"
TRANSCRIPT = f"video_id string, url string, title string, category string, fps double, segments array<{SEGMENT}>"
TOPIC = (
    "struct<id:string,title:string,topic:string,topic_id:string,description:string,summary:string,evidence_quotes:array<string>,start_s:double,end_s:double,"
    "coverage_ranges:array<struct<start_idx:int,end_idx:int>>,coverage_segments:array<int>,coverage_times:array<struct<start_s:double,end_s:double>>,coverage_text:string>"
)
TOPIC_DOC = (
    f"video_id string, title string, url string, created_at string, model string, prompt_version string, chunking struct<max_duration_s:int,max_chars:int>, topics_mode string, "
    f"topics array<{TOPIC}>, llm_raw struct<mode:string,attempts:array<string>,chunks:array<struct<chunk_index:int,attempts:array<string>>>>"
)
#: Flags are read as text and scores with their kind: replies mix numbers, strings and booleans.
CANDIDATE = "struct<correlated:string,score:variant,reason:string,comment:string,comment_text:string,text:string,body:string,url:string>"
RESULT = f"video_id string, topic_id string, section_id string, group_id string, frame string, title string, start int, end int, frames array<string>, rep_frames array<string>, checked_pairs int, candidates array<{CANDIDATE}>"
CAPTIONS = "video_id string, frames array<struct<frame_id:string,caption:string>>"
PARAGRAPH = "doc string, para_no int, style string, text string"
VIDEO = "video_id string, url string, title string, category string, relevant string"
VIDEO_METRICS = "video_id string, frames long, transcript_words long, topics long, comments long, corr_avg double, corr_median double, corr_n long, corr_n_over long, duration_s double"
AGGREGATE = "label string, num_videos long, avg_frames double, avg_transcript_words double, avg_topics double, avg_comments double, avg_corr_avg double, median_corr_avg double"
REPORT_BLOCK = "video_id string, seq int, kind string, level int, text string"
INFO = "webpage_url string, original_url string, title string, categories array<string>"
