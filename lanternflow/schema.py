"""Table contracts, as DDL."""

BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"
CLIPS = "clip_id string, path string, width int, height int, fps double, frame_count long"
FRAMES = "clip_id string, frame_idx long, ts_s double"
OBJECTS = f"clip_id string, frame_idx long, ts_s double, det_ord long, track_id long, cls string, confidence double, bbox {BBOX}"
WEAPON_RAW = f"clip_id string, frame_idx long, person_track_id long, box_ord long, class_name string, confidence double, crop_bbox {BBOX}"
HITS = f"clip_id string, frame_idx long, person_track_id long, confidence double, bbox {BBOX}"
SAMPLES = "clip_id string, frame_idx long, ts_s double, vehicle_track_id long, score double, track_ids array<long>"
EVENTS = "clip_id string, event_type string, start_timestamp_s double, end_timestamp_s double, start_frame_idx long, end_frame_idx long, peak_score double, track_ids array<long>"
LABEL_LINES = "source string, split string, image_stem string, line_no int, line string"
