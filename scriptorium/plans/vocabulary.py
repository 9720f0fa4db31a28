"""Concept vocabulary of the query language: synonyms that name a concept, and terms a concept expands to."""

from __future__ import annotations

import re

#: Patterns that name a topic, a modality or a venue.
TOPIC_SYNONYMS = (
    (r"foundation[\s-]models?|foundational models?|\bfms?\b|self[\s-]supervised|pre[\s-]?train(ing|ed)?|generalist", "foundation-model"),
    (r"vision[\s-]language|\bvlms?\b|multimodal llms?|\bmllms?\b|image[\s-]text|report generation|\bvqa\b|medical clip|radiology clip", "vlm"),
    (r"uncertaint(y|ies)|uncertainty[\s-]aware|epistemic|aleatoric|confidence estimation|reliabilit(y|ies)|trustworth", "uncertainty"),
    (r"calibrat(ion|ed)", "calibration"),
    (r"conformal", "conformal-prediction"),
    (r"selective prediction|abstention|abstain", "selective-prediction"),
    (r"out[\s-]of[\s-]distribution|\bood\b|failure detection", "ood"),
    (r"distribution shift|domain shift|dataset shift", "distribution-shift"),
    (r"robustness|fairness|shortcut|external validation", "robustness"),
    (r"hallucinat", "vlm-reliability"),
)
MODALITY_SYNONYMS = (
    (r"chest\s?x[\s-]?rays?|\bcxrs?\b|chest radiograph", "cxr"),
    (r"\bct\b|computed tomography", "ct"),
    (r"mammo(graph(y|ic)|grams?)?\b|breast imaging|tomosynthesis|\bdbt\b", "mammo"),
    (r"\bradiology\b(?! vlm)|medical imaging", "radiology-general"),
)
VENUE_SYNONYMS = (
    (r"\bmiccai\b", "miccai"), (r"\bmidl\b", "midl"), (r"\bneurips\b|\bnips\b", "neurips"), (r"\bicml\b", "icml"),
    (r"\biclr\b", "iclr"), (r"\bcvpr\b", "cvpr"), (r"\biccv\b", "iccv"), (r"\beccv\b", "eccv"), (r"\btpami\b", "tpami"),
    (r"\btmi\b|transactions on medical imaging", "tmi"), (r"\bmedia\b|medical image analysis", "medical_image_analysis"),
    (r"radiology:? ?(ai|artificial intelligence)", "radiology_ai"), (r"\baaai\b", "aaai"), (r"\bijcai\b", "ijcai"), (r"\bisbi\b", "isbi"),
    (r"\bjmlr\b", "jmlr"), (r"\btnnls\b", "tnnls"), (r"european radiology|\beur\.? radiol", "european_radiology"),
    (r"journal of digital imaging|\bj\.? digit\.? imaging|imaging informatics in medicine", "jdi"),
    (r"artificial intelligence in medicine", "aim"), (r"\brsna\b", "rsna"),
)
#: Terms that a concept stands for in a query.
MODALITY_TERMS = {
    "cxr": ["chest x-ray", "chest radiograph", "chest radiography", "CXR"],
    "ct": ["computed tomography", "CT scans", "chest CT", "CT images", "CT volumes"],
    "mammo": ["mammography", "mammogram", "breast imaging", "breast tomosynthesis"],
    "radiology-general": ["radiology", "medical imaging", "radiograph"],
}
TOPIC_TERMS = {
    "foundation-model": ["foundation model", "self-supervised", "pretraining", "pre-training", "zero-shot", "generalist"],
    "vlm": ["vision-language", "vision language model", "report generation", "image-text", "multimodal large language model", "visual question answering", "CLIP"],
    "uncertainty": ["uncertainty", "calibration", "conformal", "out-of-distribution", "selective prediction", "failure detection"],
    "calibration": ["calibration", "miscalibration", "confidence estimation"],
    "conformal-prediction": ["conformal prediction", "conformal"],
    "selective-prediction": ["selective prediction", "abstention", "selective classification"],
    "ood": ["out-of-distribution", "OOD detection", "failure detection"],
    "distribution-shift": ["distribution shift", "domain shift", "external validation"],
    "robustness": ["robustness", "distribution shift", "domain shift", "fairness", "shortcut learning"],
    "vlm-reliability": ["hallucination", "calibration", "uncertainty", "factual consistency"],
    "report-generation": ["report generation"],
    "image-text-pretraining": ["image-text pretraining", "vision-language pretraining", "contrastive language-image"],
    "hallucination": ["hallucination", "factual consistency"],
}
#: Words without weight in a query.
STOPWORDS = frozenset((
    "a", "an", "the", "and", "or", "of", "for", "in", "on", "to", "with", "without", "using", "use", "based", "via", "from",
    "about", "into", "toward", "towards", "by", "at", "as", "is", "are", "its", "their", "that", "which", "paper", "papers",
    "article", "articles", "study", "studies", "work", "research", "method", "methods", "approach", "approaches", "new",
    "novel", "recent", "latest", "relevant", "important", "me", "my",
))


def concepts(text: str, synonyms=TOPIC_SYNONYMS) -> list[str]:
    """The concepts that a text names, in the table's order, each once."""
    return list(dict.fromkeys(key for pattern, key in synonyms if re.search(pattern, text, re.IGNORECASE)))
