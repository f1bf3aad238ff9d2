"""Explicit schemas of every file the library reads; nothing is inferred."""

SENSOR_LOG = """seq long, type string, t double, unix double, lat double, lon double, alt double, speed double, course double, hacc double, vacc double,
uax double, uay double, uaz double, gvx double, gvy double, gvz double, rrx double, rry double, rrz double, qw double, qx double, qy double, qz double, _corrupt_record string"""

SESSION_META = """schema int, device string, systemVersion string, startedAt string, clock struct<videoStartHostTime: double, stopHostTime: double>,
video struct<preset: string, requestedFps: int, rotationAngleAtStart: double, stabilization: string>, units map<string, string>, recordingError string"""

DETECTIONS = "width int, height int, frames array<struct<index: int, time: double, detections: array<struct<label: string, score: double, box: array<double>>>>>"

MARKER = "samples array<struct<t: double, x: double, y: double, radius: double>>, arcs array<struct<start: double, peak: double, `end`: double, height: double>>, animatedUntil double, medianRadius double"

TIMELINE = """surfaces array<struct<`from`: double, surface: string>>, events array<struct<time: double, type: string, label: string, height: double, airTime: double, duration: double, window: double>>,
hidden array<struct<`from`: double, `to`: double>>, behindSpans array<struct<`from`: double, `to`: double>>, frontSpans array<struct<`from`: double, `to`: double>>,
pathAdjust array<struct<`from`: double, `to`: double, dy: double>>, sizeDepth array<struct<`from`: double, `to`: double, y: double>>, occluderLabels array<string>,
surfaceOffsets map<string, double>, eventWindows map<string, double>, authoritativeEvents boolean, ballScale double, postMarkerColumn double"""

LEVEL = """version int, source struct<file: string, fps: double, width: int, height: int, duration: double>, playbackFile string, travelDirection double, markerDiameter double, characterColumn double, timeToDistance array<struct<t: double, d: double>>,
path array<struct<d: double, y: double, x: double, z: double, s: string>>, screenSpeed array<struct<d: double, v: double>>, ambient array<struct<d: double, r: double, g: double, b: double>>,
events array<struct<id: int, type: string, label: string, time: double, distance: double, window: double, windowDistance: double, height: double, windowSeconds: double, lead: double, airTime: double, duration: double, source: string>>,
hidden array<struct<startDistance: double, endDistance: double, startTime: double, endTime: double>>,
foreground array<struct<d: double, id: int, x1: double, y1: double, x2: double, y2: double, mask: int, u1: double, v1: double, u2: double, v2: double>>"""

SURFACES = "clip_id string, frame int, t double, run_line array<int>, coverage double, width int, height int"
LEDGES = "clip_id string, t double, surface string, line array<int>, width int, height int"
RAW_ROWS = "image_id string, row_idx int, values array<float>"
