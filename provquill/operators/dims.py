"""Constant dimensions.  Callers may pass their own rows to every function that takes one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Vendor:
    token: str
    org: str
    platform: str | None = None
    needle: str | None = None
    synthid: bool = False
    asserts_ai: bool = False
    needs_watermark_action: bool = False


_BYTEDANCE = "ByteDance (Doubao / Jimeng / Dreamina / Volcano Engine)"

# Signing organisations; their order is their priority.
VENDORS = (
    Vendor("Microsoft", "Microsoft", "Microsoft (Copilot / Designer)", "Microsoft"),
    Vendor("Adobe", "Adobe", "Adobe Firefly", "Adobe"),
    Vendor("OpenAI", "OpenAI", "OpenAI (ChatGPT / gpt-image / DALL-E / Sora)", "OpenAI", synthid=True, needs_watermark_action=True),
    Vendor("Google", "Google LLC", "Google (Gemini / Imagen)", "Google", synthid=True),
    Vendor("Stability AI", "Stability AI", "Stability AI (Stable Image / DreamStudio)", "Stability AI"),
    Vendor("Black Forest Labs", "Black Forest Labs", "Black Forest Labs (FLUX)", "Black Forest Labs"),
    Vendor("volcengine", "ByteDance (Volcano Engine)", _BYTEDANCE, "ByteDance"),
    Vendor("北京火山引擎科技有限公司", "ByteDance (Volcano Engine)", _BYTEDANCE, "ByteDance"),
    Vendor("Byteplus", "BytePlus (ByteDance)", _BYTEDANCE, "ByteDance"),
    Vendor("Dreamina", "ByteDance (Dreamina)", _BYTEDANCE, "ByteDance", asserts_ai=True),
    Vendor("Canva", "Canva", "Canva (Magic Media)", "Canva"),
    Vendor("Eleven Labs", "ElevenLabs", "ElevenLabs", "ElevenLabs"),
    Vendor("fal-ai", "fal.ai", "fal.ai", "fal.ai", asserts_ai=True),
    Vendor("Bria", "Bria Artificial Intelligence", "Bria AI", "Bria", asserts_ai=True),
    Vendor("Truepic", "Truepic"),
)

# Claim generators (lower case) and their products.
CLAIM_GENERATORS = (
    ("adobe_firefly", "Adobe Firefly"),
    ("firefly", "Adobe Firefly"),
    ("dreamina", _BYTEDANCE),
    ("higgsfield ai", "Higgsfield AI"),
    ("topaz labs image api", "Topaz Labs"),
    ("tiktok ad creative toolbox", "TikTok Ad Creative Toolbox"),
)

# Tools named in manifests.
AI_TOOLS = (("GPT-4o", "GPT-4o"), ("ChatGPT", "ChatGPT"), ("Sora", "Sora"), ("DALL-E", "DALL-E"), ("DALL", "DALL-E"), ("Imagen", "Imagen"), ("Firefly", "Firefly"), ("Dreamina", "Dreamina"))

# Soft bindings.
SOFT_BINDINGS = (
    ("com.adobe.trustmark", "Adobe TrustMark"),
    ("com.adobe.icn", "Adobe (content fingerprint)"),
    ("com.digimarc", "Digimarc"),
    ("com.imatag.lamark", "Imatag (Lamark)"),
    ("ai.steg", "Steg.AI"),
    ("com.microsoft.invismark", "Microsoft InvisMark"),
    ("com.microsoft.wavmark", "Microsoft WavMark"),
    ("com.verimatrix", "Verimatrix"),
    ("com.nagra.nexguard", "NAGRA NexGuard"),
    ("com.aiwatermark", "AIWatermark (Meta PixelSeal)"),
    ("ai.trufo", "Trufo"),
    ("app.overlai", "Overlai"),
    ("com.markany", "MarkAny"),
    ("com.mentaport", "Mentaport"),
    ("es.lumatrace", "LumaTrace"),
    ("ai.verda", "VerdaAI"),
    ("ai.contentlens", "ContentLens"),
    ("io.iscc", "ISCC (content code)"),
)

# Generator names as they occur, lower-cased, in metadata values.
GENERATOR_TOKENS = (
    "firefly", "dall-e", "dalle", "midjourney", "stable diffusion", "stable-diffusion", "stablediffusion", "comfyui", "automatic1111", "invokeai", "imagen", "gpt-image", "nightcafe",
    "ideogram", "leonardo", "flux", "dreamstudio", "novelai", "reve.com", "luma ai", "lumalabs", "aphrodite ai", "apple photos clean up", "fal-ai",
)

# Capture devices and signing applications.
DEVICES = (
    ("lc_c2pa", "Leica (camera, C2PA capture)"),
    ("Leica Camera", "Leica (camera, C2PA capture)"),
    ("NIKON", "Nikon (camera, C2PA capture)"),
    ("Pixel Camera", "Google Pixel (camera, C2PA capture)"),
    ("sony.sig", "Sony (camera, C2PA capture)"),
    ("sony.cert", "Sony (camera, C2PA capture)"),
    ("Truepic_Lens", "Truepic Lens (verified capture)"),
)
SIGNERS = (("Samsung Galaxy", "Samsung Galaxy (C2PA)"), ("com.asus.gallery", "ASUS Gallery (C2PA signer)"))

# Tokens (lower case) of coarse vendors, in the order they are tried.
VENDOR_TOKENS = (
    ("gpt-image", "OpenAI"), ("dall", "OpenAI"), ("sora", "OpenAI"), ("openai", "OpenAI"),
    ("gemini", "Google"), ("imagen", "Google"), ("nano banana", "Google"), ("google", "Google"),
    ("firefly", "Adobe"), ("adobe", "Adobe"),
    ("copilot", "Microsoft"), ("bing", "Microsoft"), ("designer", "Microsoft"), ("microsoft", "Microsoft"),
    ("stability", "Stability AI"), ("stable diffusion", "Stability AI"), ("sdxl", "Stability AI"),
    ("ideogram", "Ideogram"), ("grok", "xAI"), ("aurora", "xAI"), ("xai", "xAI"),
    ("bytedance", "ByteDance"), ("doubao", "ByteDance"), ("jimeng", "ByteDance"), ("dreamina", "ByteDance"), ("volcengine", "ByteDance"), ("volcano engine", "ByteDance"),
    ("canva", "Canva"), ("elevenlabs", "ElevenLabs"), ("eleven labs", "ElevenLabs"), ("black forest", "Black Forest Labs"),
    ("fal-ai", "fal.ai"), ("bria", "Bria"), ("apple photos clean up", "Apple"), ("luma ai", "Luma AI"), ("lumalabs", "Luma AI"),
)

# Disclosure markers and fields.
IPTC_MARKERS = ("trainedAlgorithmicMedia", "compositeSynthetic", "compositeWithTrainedAlgorithmicMedia")
IPTC_FIELDS = ("AISystemUsed", "AISystemVersionUsed", "AIPromptInformation", "AIPromptWriterName")
AIGC_MARKERS = ("tc260.org.cn/ns/AIGC", "TC260:AIGC")
TC260_FIELDS = ("Label", "ContentProducer", "ProduceID", "ContentPropagator", "PropagateID", "ReservedCode1", "ReservedCode2", "ServiceProvider", "ServiceUser")
METADATA_KEYS = (
    "parameters", "prompt", "negative_prompt", "workflow", "comfyui", "sd-metadata", "invokeai_metadata", "generation_data", "ai_metadata", "dream", "sd:prompt", "sd:negative_prompt",
    "sd:seed", "sd:steps", "sd:sampler", "sd:cfg_scale", "sd:model_hash", "c2pa", "c2pa_chunk", "software",
)
METADATA_KEYWORDS = ("stable_diffusion", "comfyui", "automatic1111", "invokeai", "midjourney", "dall-e", "dalle", "imagen", "synthid", "google_ai", "openai", "c2pa")
APP_PRODUCTS = (("doubao", "ByteDance Doubao"), ("xinghui", "ByteDance Xinghui"), ("dreamina", "ByteDance Dreamina"), ("dreamina_oversea", "ByteDance Dreamina"))

# Visible marks (mark, corner, front end, scale basis, gate, relaxed factor, rivals).
MARKS = (
    ("gemini", "br", "alpha", "tier", 0.50, None, ()),
    ("doubao", "br", "tophat", "short", 0.50, 0.7, ()),
    ("jimeng", "br", "binary", "width", 0.45, 0.7, ("doubao",)),
    ("qwen", "br", "tophat", "short", 0.45, 1.0, ()),
    ("kling", "br", "tophat", "short", 0.35, 1.0, ()),
    ("yuanbao", "br", "contrast", "short", 0.38, 1.0, ()),
    ("baidu", "br", "tophat", "short", 0.48, 1.0, ("doubao", "qwen")),
    ("liblib", "bc", "tophat", "width", 0.42, 1.0, ()),
    ("runninghub", "tl", "gray", "width", 0.34, 1.0, ()),
    ("samsung", "bl", "binary", "width", 0.40, 0.7, ()),
    ("jimeng_pill", "tl", "edge", "width", 0.22, None, ()),
)


def vendors(spark: SparkSession) -> DataFrame:
    """The vendor dimension with its priority; small enough to broadcast."""
    rows = [(k, v.token, v.org, v.platform, v.needle, v.synthid, v.asserts_ai, v.needs_watermark_action) for k, v in enumerate(VENDORS)]
    return spark.createDataFrame(rows, "prio int, token string, org string, platform string, needle string, synthid boolean, asserts_ai boolean, needs_watermark_action boolean")


def marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *m[:6], list(m[6])) for k, m in enumerate(MARKS)], "prio int, mark string, corner string, front_end string, scale_basis string, gate double, relaxed_factor double, rivals array<string>")

# Hosts of manifest stores.
MANIFEST_HOSTS = (("cai-manifests.adobe.com", "Adobe Content Authenticity"),)

# Families of watermark descriptions, by tokens of their lower-cased text.
FAMILIES = (
    ("synthid", ("synthid",)),
    ("visible_sparkle", ("sparkle",)),
    ("visible_doubao", ("豆包", "doubao")),
    ("visible_jimeng", ("即梦", "jimeng")),
    ("visible_samsung", ("galaxy ai", "generati dall")),
    ("aigc_tc260", ("aigc", "tc260")),
    ("iptc", ("iptc", "digitalsourcetype", "made with ai", "made-with-ai")),
    ("c2pa", ("c2pa", "content credentials")),
    ("trustmark", ("trustmark",)),
    ("open_invisible", ("open invisible", "dwt", "stable diffusion xl")),
    ("xai_signature", ("xai", "grok signature")),
    ("exif_generator", ("exif", "software tag", "png text")),
)

# Markers whose presence in an unknown file is worth a look.
GAP_MARKERS = (
    "c2pa", "jumbf", "contentauth", "trainedAlgorithmicMedia", "digitalSourceType", '"AIGC"', "<TC260:AIGC>", "TC260:AIGC", "tc260.org.cn", "AISystemUsed", "SynthID", "hf-job-id", "genAIType",
    "PhotoEditor_Re_Edit", "Signature:", "Midjourney", "Stable Diffusion", "StableDiffusion", "ComfyUI", "Automatic1111", "DALL-E", "Ideogram AI", "Adobe Firefly", "Black Forest", "volcengine",
    "Doubao", "豆包", "Nano Banana", "Stability AI", "Samsung Galaxy",
)

# Payloads of open watermarks, and the bits that must agree.
PAYLOADS_48 = (("Stable Diffusion XL", 0b101100111110110010010000011110111011000110011110), ("FLUX.2 (Black Forest Labs)", 0b001010101111111010000111100111001111010100101110))
PAYLOAD_TEXT, MATCH_48, MATCH_TEXT = "StableDiffusionV1", 44, 0.92

# The container of an editor's marker, and keys of external records that describe the collector, not the file.
SAMSUNG_MARKER = "PhotoEditor_Re_Edit_Data"
DIAGNOSTIC_KEYS = (
    "artifacts", "birthtime", "color", "content_format", "dct", "ela", "error", "extension", "fft", "file", "filename", "full", "gradient", "kind", "mtime", "name", "noise", "path", "pixel",
    "provenance", "sha256", "signals", "size_bytes", "timing_ms",
)

# Validation codes of credentials.
BINDING_MATCHES = ("assertion.dataHash.match", "assertion.bmffHash.match", "assertion.boxesHash.match", "assertion.collectionHash.match", "assertion.multiAssetHash.match")
BINDING_FAILURES = ("Hash.incorrectFileCount", "Hash.malformed", "Hash.mismatch", "Hash.missingPart", "assertion.hashedURI.mismatch", "claim.hardBindings.missing", "hashedUri.mismatch", "ingredient.manifest.mismatch")
SIGNATURE_FAILURES = ("claimSignature.mismatch", "claimSignature.missing", "claimSignature.outsideValidity")
