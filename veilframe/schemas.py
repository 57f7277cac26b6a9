"""Declared schemas of files and tables."""
LABELLED_EXAMPLE = "words array<string>, boxes array<array<int>>, labels array<string>"

FEATURES = (
    "struct<score:double,priority:int,rel_x:double,rel_y:double,rel_width:double,rel_height:double,"
    "word_len:int,is_upper:int,has_digit:int,num_tokens:int,label_id:int>"
)
FEEDBACK = (
    "page_hash string, label string, pattern string, score double, "
    f"features {FEATURES}, timestamp double, session_id string, "
    "user_feedback boolean, feedback_time double, missed_detection boolean, word string"
)
CALIBRATION = "map<string,array<struct<score:double,correct:boolean,correction:double,timestamp:double>>>"
TOKENS = (
    "doc_id bigint, page_no int, pos bigint, text string, left_x int, top int, "
    "width int, height int, conf double, source string"
)
FRAME_DETECTIONS = "video_id bigint, frame_no int, det_id bigint, type string, x1 int, y1 int, x2 int, y2 int, score double"
FEEDBACK_ROWS = "page_hash string, label string, pattern string, score double, user_feedback boolean, missed_detection boolean, ts timestamp"
