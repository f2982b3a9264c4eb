"""Fixed values that results depend on: word lists, lookup tables and constants."""

from __future__ import annotations

# Version of the store's schema, and of the analysis (major * 10000 + minor * 100 + patch).
SCHEMA_VERSION, ALGORITHM_VERSION = 3, 1087
# Bytes beyond which the store evicts, and the share of records it then evicts.
SIZE_LIMIT_BYTES, EVICT_SHARE = 85 * 1024**3, 7
# Seconds after which analysis records expire.
EXPIRE_SECS = 30 * 24 * 3600

# Extensions by kind.
IMAGE_EXTENSIONS = "png jpg jpeg jpe jfif webp gif tiff tif heic heif avif bmp ico svg jp2 j2k jxl".split()
VIDEO_EXTENSIONS = "mp4 mov avi mkv webm m4v wmv flv mpg mpeg ts mts m2ts m2v 3gp 3g2 ogv f4v asf".split()
SIDECAR_EXTENSIONS = ["xmp"]
SHELL_IMAGE_EXTENSIONS = "jpg jpeg jpe jfif png webp heic heif avif gif tiff tif bmp".split()
SHELL_VIDEO_EXTENSIONS = "mp4 mov mkv avi webm m4v wmv flv".split()
NOT_MEDIA_EXTENSIONS = (
    "xmp txt md json xml yaml yml toml ini cfg conf log rs py js ts html css sh bash zsh c cpp h hpp java "
    "zip tar gz bz2 xz 7z rar ds_store thumbs.db desktop.ini"
).split()
# Order in which image formats are worked on; others come last, at 6.
FORMAT_PRIORITY = {
    0: "jpg jpeg jpe jfif", 1: "png bmp ico", 2: "webp", 3: "heic heif avif", 4: "gif", 5: "tiff tif jp2 j2k svg",
}
# Source extensions whose time stamps are restored, in order.
TIMESTAMP_EXTENSIONS = "jpg jpeg png webp heic heif avif gif tiff tif bmp jxl".split()
LIVE_STILLS, LIVE_STILL_COMPANIONS = ["heic", "heif", "hif"], ["heic", "HEIC", "heif", "HEIF"]

# Codec, efficiency, substrings of its names; a name in = signs must be equal. The first match counts.
SOURCE_CODECS = """
Vvc 0.35 vvc|h266|h.266
Av2 0.35 av2|avm
Av1 0.50 av1|svt|aom|libaom
H265 0.65 h265|hevc|x265|h.265
Vp9 0.70 vp9
Vp8 0.85 vp8|=libvpx=
H264 1.0 h264|avc|x264|h.264
Mpeg4 1.3 mpeg4|xvid|divx|mp4v
Mpeg2 1.8 mpeg2
Mpeg1 2.5 mpeg1
Wmv 1.1 wmv|vc1|vc-1
Theora 1.2 theora
RealVideo 2.0 rv10|rv20|rv30|rv40|realvideo
FlashVideo 1.5 flv|vp6|flashsv
ProRes 1.8 prores
DnxHD 1.8 dnxh|dnxhr
Mjpeg 2.5 mjpeg|motion jpeg
Ffv1 1.0 ffv1
UtVideo 1.0 utvideo|ut video
HuffYuv 1.0 huffyuv|ffvhuff
RawVideo 1.0 rawvideo|=raw=
Lagarith 1.0 lagarith
MagicYuv 1.0 magicyuv
Gif 3.0 gif
Apng 1.8 apng
JpegXl 0.6 jxl|jpeg xl|jpegxl
Avif 0.55 avif
Heic 0.65 heic|heif
WebpAnimated 0.9 webp&anim
WebpStatic 0.75 webp
Jpeg 1.0 jpeg|jpg
Png 1.5 png
Bmp 3.0 bmp|bitmap
Tiff 1.2 tiff|tif
"""
LOSSLESS_CODECS = "Ffv1 UtVideo HuffYuv RawVideo Lagarith MagicYuv Png Apng Bmp".split()
MODERN_CODECS = "H265 Av1 Vp9 Vvc Av2 JpegXl Avif Heic".split()
CUTTING_EDGE_CODECS = "Vvc Av2".split()
SKIPPED_VIDEO_CODECS = "H265 Av1 Vp9 Vvc Av2".split()
APPLE_INCOMPATIBLE_CODECS = "Av1 Vp9 Vvc Av2".split()

# Exact codec names | codec | shown as.
DETECTED_CODECS = """
ffv1 | FFV1 | FFV1
prores,prores_ks | ProRes | ProRes
dnxhd,dnxhr | DNxHD | DNxHD
huffyuv,ffvhuff | HuffYUV | HuffYUV
utvideo | UTVideo | UT Video
rawvideo | RawVideo | Raw Video
hevc,h265,libx265 | H265 | H.265/HEVC
av1,libaom-av1,libsvtav1 | AV1 | AV1
vp9,libvpx-vp9 | VP9 | VP9
vvc,h266,libvvenc | VVC | H.266/VVC
h264,avc,libx264 | H264 | H.264/AVC
vp8,libvpx | VP8 | VP8
mpeg4,xvid,divx | MPEG4 | MPEG-4
mpeg2video | MPEG2 | MPEG-2
mpeg1video | MPEG1 | MPEG-1
wmv1,wmv2,wmv3,vc1 | WMV | WMV
gif | GIF | GIF
apng | APNG | APNG
webp | WebPAnim | WebP (Animated)
"""
# Exact codec names | name | long name | category | lossless | typical extension.
CODEC_INFO = """
ffv1 | FFV1 | FF Video 1 (Lossless) | Archival | true | mkv
prores,prores_ks | ProRes | Apple ProRes | Production | false | mov
dnxhd,dnxhr | DNxHD | Avid DNxHD/DNxHR | Production | false | mxf
h264,avc,libx264 | H.264 | H.264 / AVC | Delivery | false | mp4
hevc,h265,libx265 | H.265 | H.265 / HEVC | Delivery | false | mp4
vp9,libvpx-vp9 | VP9 | Google VP9 | Delivery | false | webm
av1,libaom-av1,libsvtav1 | AV1 | AOMedia Video 1 | Delivery | false | mp4
vvc,h266,libvvenc | H.266 | H.266 / VVC | Delivery | false | mp4
rawvideo | Raw | Uncompressed Video | Archival | true | avi
huffyuv,ffvhuff | HuffYUV | Huffman YUV Lossless | Archival | true | avi
utvideo | UT Video | Ut Video Lossless | Archival | true | avi
"""
DETECTED_MODERN, DETECTED_LOSSLESS, DETECTED_PRODUCTION = "H265 AV1 AV2 VP9 VVC".split(), "FFV1 HuffYUV UTVideo RawVideo".split(), "ProRes DNxHD".split()

# Content type -> change of the rate factor.
CONTENT_ADJUSTMENT = {"Animation": 4, "ScreenRecording": 5, "LiveAction": 0, "Gaming": -1, "FilmGrain": -3}

# Codecs that the precheck strongly recommends to replace, and those it leaves alone.
LEGACY_CODECS = (
    "theora rv30 rv40 realvideo vp6 vp7 wmv1 wmv2 wmv3 msmpeg4v1 msmpeg4v2 msmpeg4v3 cinepak indeo iv31 iv32 iv41 iv50 "
    "svq1 svq3 flv1 msvideo1 msrle 8bps qtrle rpza mjpeg mjpegb"
).split()
OPTIMAL_CODECS = "hevc h265 x265 hvc1 av1 av01 libaom-av1".split()

# Content classifier, as name | priority | conditions with bounds included.
CLASSIFIER = """
ANIMATION | 1000 | is_animated=true
ICON | 950 | width<=512 height<=512 has_alpha=true complexity<=0.4
MANGA | 920 | color_diversity<=0.3 edge_density>=0.25 texture_variance>=0.15 contrast>=0.5
DOCUMENT | 900 | color_diversity<=0.1 edge_density>=0.3 contrast>=0.8 texture_variance<=0.15
MAP | 850 | color_diversity>=0.6 edge_density>=0.4 texture_variance<=0.3
GAME_CAPTURE | 800 | aspect_ratio>=1.3 aspect_ratio<=2.5 complexity>=0.6 color_diversity>=0.4 edge_density>=0.3
MOBILE_SCREENSHOT | 750 | aspect_ratio>=0.4 aspect_ratio<=0.6 color_diversity<=0.3 edge_density>=0.15 complexity<=0.5
SCREENSHOT | 700 | aspect_ratio>=1.3 aspect_ratio<=2.2 color_diversity<=0.35 edge_density>=0.2 complexity<=0.55
WEB_UI | 680 | edge_density>=0.3 color_diversity<=0.4 contrast>=0.5
NIGHT_PHOTO | 650 | contrast<=0.4 noise_level>=0.5
MACRO_PHOTO | 600 | sharpness>=0.6 texture_variance>=0.5
MEME | 550 | edge_density>=0.25 color_diversity>=0.2 color_diversity<=0.5 contrast>=0.6
ARTWORK | 500 | complexity>=0.3 complexity<=0.8 edge_density>=0.15
PHOTO | 400 | complexity>=0.55 color_diversity>=0.45
"""

# Base quantisation tables of the JPEG standard, luminance and chrominance.
JPEG_LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
JPEG_CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
]

# How much each place of a quantisation table weighs.
JPEG_WEIGHTS = [
    1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.9, 0.85, 0.75, 0.65, 0.55, 0.45, 0.35, 0.25, 0.8, 0.75, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.7, 0.65, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15,
    0.6, 0.55, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.5, 0.45, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.4, 0.35, 0.3, 0.2, 0.15, 0.1, 0.08, 0.05, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03,
]

# Messages that pause a run, in lower case.
DISK_FULL = [
    "no space left on device", "disk full", "storage full", "database or disk is full", "there is not enough space on the disk",
    "not enough space", "enospc", "no usable temporary file name found",
]

# Date sources by falling priority, as column | name.
DATE_SOURCES = [
    ("xmp_ps_created", "XMP-Photoshop"), ("xmp_created", "XMP-CreateDate"), ("xmp_history", "XMP-History"),
    ("exif_original", "EXIF-Original"), ("exif_created", "EXIF-CreateDate"), ("xmp_metadata", "XMP-Metadata"),
]

# File names of machine origin begin so; vendors of animated stickers.
MACHINE_PREFIXES = ["mmexport", "wx_camera", "wx_image", "IMG_", "VID_", "Screenshot_", "signal-", "telegram-"]
STICKER_VENDORS = ["GIPHY", "TENOR", "STICKER"]

# Magic numbers (hex, at the start) and the format.
MAGIC = """
89504E470D0A1A0A PNG
FFD8FF JPEG
474946383761 GIF
474946383961 GIF
FF0A JXL
0000000C4A584C20 JXL
49492A00 TIFF
4D4D002A TIFF
49492B00 TIFF
4D4D002B TIFF
424D BMP
716F6966 QOI
0000000C6A502020 JP2
FF4FFF51 JP2
00000100 ICO
00000200 ICO
762F3101 EXR
464C4946 FLIF
"""
# Brands of ISO base media files and the format.
BRANDS = {"AVIF": "avif avis MA1B MA1A", "HEIC": "heic heix heim heis hevc hevx hev1", "HEIF": "heif"}
MODERN_IMAGE_FORMATS = ["HEIC", "HEIF", "AVIF", "JXL"]

# Margins in bytes.
MARGIN_MIN, MARGIN_MAX, MARGIN_SHARE = 2_048, 102_400, 0.005
SMALL_FILE, TOLERANCE, DISK_HEADROOM = 10 * 1024**2, 1_048_576, 1024**3
# Bytes of a container besides its streams, as a share.
CONTAINER_OVERHEAD = {"mov": 0.005, "mp4": 0.001, "m4v": 0.001, "mkv": 0.0005, "webm": 0.0005}
OTHER_OVERHEAD = 0.002


def rows(text: str, separator: str | None = " | ") -> list[list[str]]:
    """The lines of a table above, split."""
    return [[p.strip() for p in line.split(separator)] for line in text.strip().splitlines()]

# Targets of video conversion, their extensions and names; image formats that are modern already.
TARGETS = {
    "Ffv1Mkv": ("MKV", "FFV1 MKV (Archival)"), "Av1Mp4": ("MP4", "AV1 MP4 (High Quality)"), "HevcLosslessMkv": ("MKV", "HEVC Lossless MKV (Archival)"),
    "HevcMp4": ("MP4", "HEVC MP4 (High Quality)"), "Skip": ("", "Skip"),
}
MODERN_FORMATS = ("HEIC", "HEIF", "AVIF", "JXL")
