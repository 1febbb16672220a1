"""Schemas of the JSON inputs."""

STREAM = (
    "codec_type string, codec_name string, avg_frame_rate string, r_frame_rate string, pix_fmt string, "
    "bit_rate string, duration string, width string, height string, bits_per_raw_sample string, color_transfer string"
)
PROBE = f"format struct<duration: string, bit_rate: string>, streams array<struct<{STREAM.replace(' string', ': string')}>>"
SCORES = (
    "pooled_metrics struct<vmaf: struct<mean: double>>, "
    "frames array<struct<frameNum: bigint, metrics: struct<vmaf: double>>>"
)
PHASE = "phase string, seconds string"
MEASUREMENT = (
    "struct<analysis_wall_seconds: double, final_encode_wall_seconds: double, smart_passed: boolean, "
    "ground_truth_passed: boolean, smart_size_blocked: boolean, full_encode_output_bytes: bigint, "
    "max_output_bytes: bigint, selected_video_bitrate_bps: bigint, oracle_minimum_bitrate_bps: bigint>"
)
MANIFEST = (
    "schema_version int, cases array<struct<id: string, source: string, command: array<string>, "
    f"measurement: {MEASUREMENT}, metadata: map<string, string>>>"
)
MANIFEST_VERSION = 1
RECORD_VERSION = 1
RECEIPT_SCHEMA_VERSION = 1
RECEIPT_SCHEME_VERSION = 1
