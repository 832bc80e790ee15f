"""Word lists and patterns. All of these are fixed values: results depend on every entry and on their order."""

import re

# fixed values: units that may follow a number
UNITS = "%|ms|s|sec|seconds|minutes|min|hrs|hours|gb|mb|kb|hz"
# fixed values: metric names looked for at ingestion
METRICS = (
    r"accuracy|f1-macro|f1-score|f1|bleu|rouge|rouge-l|rouge-1|rouge-2|map|mAP|mrr|auc|precision|recall|wer|cer|latency|perplexity"
    r"|top-1 accuracy|top-5 accuracy|top-1|top-5|iou|ap50|ap75|meteor|spice|cider|bertscore|sacrebleu|ter|ndcg|hit rate|hit@\d+|hits@\d+"
    r"|mse|rmse|mae|mape|r2|r-squared|psnr|ssim|fid|inception score|is score|em|exact match|squad-f1|loss|error rate|misclassification"
    r"|throughput|fps|samples per second|tokens per second|reward|return|episode reward|mean reward|average reward"
    r"|spearman|pearson|kendall|correlation|dice|jaccard|sensitivity|specificity"
)
# fixed values: metric names looked for in claims
CLAIM_METRICS = (
    r"accuracy|f1-macro|f1-score|f1|bleu|rouge-l|rouge-1|rouge-2|rouge|map|mAP|mrr|auc|precision|recall|wer|cer|latency|perplexity"
    r"|top-1 accuracy|top-5 accuracy|top-1|top-5|iou|ap50|ap75|meteor|spice|cider|bertscore|sacrebleu|ter|ndcg|hit rate"
    r"|mse|rmse|mae|mape|r-squared|psnr|ssim|fid|inception score|em|exact match|squad-f1|loss|error rate|misclassification"
    r"|throughput|fps|samples per second|tokens per second|reward|return|episode reward|mean reward|average reward|score"
    r"|spearman|pearson|kendall|correlation|dice|jaccard|sensitivity|specificity"
)
# fixed values: data set names looked for at ingestion
DATASETS = (
    r"GLUE|SuperGLUE|MNLI|CoLA|SQuAD|ImageNet|WMT|CIFAR-?\s?10|CIFAR-?\s?100|COCO|MS-?\s?COCO|Pascal\s?VOC|Penn Treebank|PTB|WikiText|C4|The Pile|CommonCrawl"
    r"|LibriSpeech|Common Voice|TIMIT|VoxCeleb|ARC|HellaSwag|MMLU|TruthfulQA|Winogrande|GSM8K|LAMBADA|StoryCloze|BoolQ|PIQA|OpenBookQA"
    r"|Atari|MuJoCo|HalfCheetah|Hopper|Walker|Humanoid|Ant|Reacher|Swimmer|KITTI|Cityscapes|ADE20K|LSUN|CelebA|FFHQ|VTAB|Oxford Flowers|Stanford Cars|SVHN"
    r"|MS-?\s?MARCO|Natural Questions|TriviaQA|HotpotQA|CNN|DailyMail|XSum|SAMSum|SST-?\s?2|MRPC|QQP|QNLI|RTE|WNLI|STS-?\s?B"
)
# fixed values: abbreviations that end no sentence
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "fig.", "eq.", "dr.", "mr.", "mrs.", "prof.", "inc.", "vs.", "al.")
# fixed values: performance verbs, first listed wins
PERFORMANCE_VERBS = (
    "achieves", "attains", "obtains", "reaches", "reports", "yields", "scores", "improves", "outperforms", "surpasses", "establishes", "demonstrates", "produces",
    "delivers", "records", "shows", "exhibits", "sets", "achieved", "attained", "obtained", "reached", "reported", "observed", "measured", "recorded", "found",
    "beats", "exceeds", "rivals", "matches", "gets", "gave", "gives", "leads to", "resulted in", "results in", "evaluates to", "evaluated at", "performs at",
    "performs", "performed", "scored",
)
# fixed values: efficiency verbs, first listed wins
EFFICIENCY_VERBS = (
    "requires", "takes", "took", "trains", "trained", "costs", "consumes", "uses", "reduces", "needs", "completes", "completed", "finished", "converges",
    "converged", "runs", "ran", "executes", "processed",
)
# fixed values: structural verbs, longest wins
STRUCTURAL_VERBS = (
    "introduces", "introduce", "proposes", "propose", "removes", "remove", "replaces", "replace", "consists of", "consist of", "is based on", "are based on",
    "relies on", "rely on", "relies entirely on", "rely entirely on", "employs", "employ", "eliminates", "eliminate", "dispenses with", "dispense with",
    "eschews", "eschew", "eschewing", "uses", "use",
)
# fixed values: nouns of structural claims
STRUCTURAL_NOUNS = (
    "transformer", "model", "architecture", "network", "mechanism", "attention", "encoder", "decoder", "layer", "module", "framework", "method", "approach",
    "algorithm", "system", "pipeline", "representation", "embedding", "convolution", "recurrent", "residual", "normalization", "objective", "policy", "agent", "optimizer",
)
# fixed values: units of efficiency claims
EFFICIENCY_UNITS = r"hours?|days?|minutes?|seconds?|ms|GPUs?|TPUs?|FLOPs?|parameters?|P100|V100|A100|H100|A6000|RTX|gigabytes?|GB|MB|TB|watts?|joules?|kWh|samples?\s+per\s+second|tokens?\s+per\s+second|iterations?|steps?|wall[\s-]?clock"
# fixed values: hedges, looked for anywhere in a text
HEDGES = ("reportedly", "may", "might", "appears to", "suggests", "could")
# fixed values: phrases of relative improvement
DELTA = (
    r"improv(?:ing|es?|ed|ement)\s+(?:of|by|over)|more\s+than\s+\d|by\s+(?:over\s+)?\d|outperforms?\s+.*?\s+by\s+\d|surpass(?:es|ing)?\s+.*?\s+by\s+\d|exceeds?\s+.*?\s+by\s+\d"
    r"|better\s+than\s+.*?\s+by\s+\d|over\s+\d+(?:\.\d+)?\s+(?:BLEU|points?|percent)|gains?\s+of\s+\d|increase\s+of\s+\d|reduction\s+of\s+\d|drop\s+of\s+\d"
)
# fixed values: weak claims
WEAK_HEDGE = r"\b(?:may|might|could|should|appears|suggests|indicates|hypothesized|theoretical|estimated|approximate|roughly|approximately|about|around|perhaps|allegedly|purportedly|ostensibly|seemingly|arguably)\b"
WEAK_COMPOUND = (r"(?:dataset|metric)\s+(?:a|1)\s+(?:and|or)\s+(?:dataset|metric)\s+(?:b|2)", r"(?:or|and)\s+(?:dataset|metric)\s+(?:[a-z0-9]+)")
WEAK_DELTA = (
    r"(?:increased|improved|enhanced|boosted|accelerated|reduced|decreased|lowered|minimized|optimized|expanded|growing|climbing|rising)\s+(?:by|at|of)?\s*(\d+\.?\d*)\s*(?:%|percent|times|x|fold)",
    r"(?:from|between)\s+(\d+\.?\d*)\s+(?:to|and)\s+(\d+\.?\d*)",
    r"(\d+\.?\d*)\s*(?:x|times|fold)\s+(?:improvement|better|faster|slower|larger|smaller)",
    r"(?:baseline).*?(\d+\.?\d*)\s*(?:%|percent)",
    r"(?:p\s*[<>]|p-value)\s*(?:[<>=]+)?\s*(\d+\.?\d*)",
)
# fixed values: measurable properties of weak claims
WEAK_PROPERTY = (
    r"\b(accuracy|precision|recall|f1|f-1|bleu|rouge|loss|error|latency|throughput|memory|energy|cost|time|speed|efficiency|benchmark|score|rate|percentage|percent|yield|torque|force"
    r"|strength|pressure|temperature|conductivity|resistance|velocity|density|wavelength|frequency|power|voltage|current|impedance|gain|decibel|db|snr|psnr|quality|reliability|availability"
    r"|bandwidth|delay|qos|sla|slo|cpu|gpu|tpu|flops|operations|instruction|cycle|cache|tps|qps|ops|iops|p50|p99|p99\.9|percentile|min|max|avg|mean|median|std|stddev|sigma|variance|entropy"
    r"|kl|divergence|wasserstein|cosine|similarity|distance|correlation|coefficient|likelihood|probability|confidence|credibility|evidence|certainty|weight|count|size|dimension|ratio|multiple"
    r"|fold|factor|increase|decrease|improvement|degradation|reduction|growth|decline|regression|progression|advancement|enhancement|boost|surge|spike|drop|crash|failure|success|effectiveness"
    r"|margin|difference|delta|shift|change|variation|range|spread|distribution|histogram|quantile|bin|bucket|gradient|derivation|integral|slope|curvature|amplitude|phase|modulation|noise|signal"
    r"|resolution|pixel|frame|fps|hz|baud|bits|bytes|kb|mb|gb|tb|pb)\b"
)
# fixed values: metric tokens of normalisation
NORMAL_METRICS = (
    r"classification accuracy|model accuracy|accuracy@1|acc@1|accuracy@5|top-1 accuracy|top1 accuracy|top-1 acc|top1 acc|top-1|top1|top-5 accuracy|top5 accuracy|top-5 acc|top5 acc|top-5|top5"
    r"|accuracy|acc|f1-macro|f1 macro|f1-score|f1|bleu-4|bleu|rouge-l|rouge|latency|perplexity|ppl|map|mAP|iou|ap50|ap75|wer|cer|mrr|auc|precision|recall"
    r"|success rate|solve rate|success|solved|problems|problem|score|correct|error rate|error|throughput|tokens/sec|tokens per second|images/sec|samples/sec|compression ratio|compression rate"
    r"|incidence rate|incidence|transmission rate|hazard ratio|odds ratio|sensitivity|specificity|reduction rate|reduction|decrease"
)
# fixed values: canonical names of metric tokens without their punctuation
METRIC_ALIASES = {
    "accuracy": "ACCURACY", "acc": "ACCURACY", "classificationaccuracy": "ACCURACY", "modelaccuracy": "ACCURACY", "top1": "ACCURACY", "top1accuracy": "ACCURACY", "top1acc": "ACCURACY",
    "accuracy1": "ACCURACY", "acc1": "ACCURACY", "top5": "TOP5_ACCURACY", "top5accuracy": "TOP5_ACCURACY", "top5acc": "TOP5_ACCURACY", "accuracy5": "TOP5_ACCURACY", "f1macro": "F1_MACRO",
    "f1score": "F1", "f1": "F1", "bleu": "BLEU", "bleu4": "BLEU", "rouge": "ROUGE", "rougel": "ROUGE_L", "latency": "LATENCY", "perplexity": "PERPLEXITY", "ppl": "PERPLEXITY", "map": "MAP",
    "iou": "IOU", "ap50": "AP50", "ap75": "AP75", "wer": "WER", "cer": "CER", "mrr": "MRR", "auc": "AUC", "precision": "PRECISION", "recall": "RECALL", "score": "SCORE", "totalscore": "SCORE",
    "finalscore": "SCORE", "successrate": "SUCCESS_RATE", "solverate": "SOLVE_RATE", "solvedproblems": "SOLVE_COUNT", "problemssolved": "SOLVE_COUNT", "problems": "SOLVE_COUNT",
    "correct": "ACCURACY", "correctness": "ACCURACY", "errorrate": "ERROR_RATE", "error": "ERROR_RATE", "throughput": "THROUGHPUT", "tokenspersecond": "THROUGHPUT", "tokenssec": "THROUGHPUT",
    "imagespersecond": "THROUGHPUT", "samplessec": "THROUGHPUT", "compressionratio": "COMPRESSION_RATIO", "compressionrate": "COMPRESSION_RATIO", "incidencerate": "INCIDENCE_RATE",
    "incidence": "INCIDENCE_RATE", "transmissionrate": "TRANSMISSION_RATE", "hazardratio": "HAZARD_RATIO", "hr": "HAZARD_RATIO", "oddsratio": "ODDS_RATIO", "or": "ODDS_RATIO",
    "sensitivity": "SENSITIVITY", "specificity": "SPECIFICITY", "reductionrate": "REDUCTION_RATE", "reduction": "REDUCTION_RATE", "decrease": "REDUCTION_RATE",
}
# fixed values: phrases that compare
COMPARISONS = r"\bbaseline\b|\b(?:compared?|relative)\s+to\b|\b(?:outperform|exceed|surpass|better\s+than)\b|\b(?:previous|prior)\s+(?:work|state[-\s]of[-\s]the[-\s]art|sota)\b"
# fixed values: metrics in "name = value" artifacts
ARTIFACT_METRICS = r"accuracy|f1(?:-score|-macro)?|bleu|rouge(?:-l)?|precision|recall|auc|map|mrr|wer|cer|perplexity|mae|rmse|mse|loss"

# fixed values: cleaning of subjects
CAPTION_PREFIX = re.compile(r"^(?:Table|Figure|Fig\.?)\s*\d+\s*[:.]\s*", re.IGNORECASE)
LEADING_PREPOSITION = re.compile(r"^(?:On|For|In|With|Using)\s+(?:the\s+)?", re.IGNORECASE)
LONGEST_SUBJECT = 300
# fixed values: what numbers may count without being results
NON_PERFORMANCE = ("epoch", "epochs", "parameter", "parameters", "layer", "layers", "token", "tokens", "batch", "batch size", "training data", "split")
# fixed values: numbers of normalised claims, and what refuses one
VALUE = re.compile(r"(\d+(?:\.\d+)?)(?:\s*(%|ms|s|sec|seconds|gb|mb|kb))?", re.IGNORECASE)
REFERENCE_PREFIX = re.compile(r"(?:table|figure|fig\.?|section|§|chapter)\s*$", re.IGNORECASE)
YEARED_DATASETS = "WMT|VOC|CoNLL|COCO|MSCOCO|ImageNet|SQuAD|GLUE|SuperGLUE"
TEMPORAL = r"early|mid|late|circa|around|before|after|since|as\s+of|in"
# fixed values: abbreviations of text blocks
PROTECTED = (
    "e.g.", "i.e.", "et al.", "Fig.", "fig.", "Sec.", "sec.", "Eq.", "eq.", "Tab.", "tab.", "Dr.", "dr.", "Mr.", "mr.", "Ms.", "ms.", "Mrs.", "mrs.", "Prof.", "prof.",
    "Inc.", "inc.", "vs.", "Vol.", "vol.", "No.", "no.", "al.", "cf.", "Cf.",
)
# fixed values: phrases of each metric in plain text (phrases with marks in them can't occur there and are left out)
ONTOLOGY = {
    "ACCURACY": ("accuracy", "top1", "top 1", "top1 accuracy", "top 1 accuracy", "classification accuracy", "test accuracy", "validation accuracy", "val accuracy"),
    "TOP5_ACCURACY": ("top5", "top 5", "top5 accuracy", "top 5 accuracy"),
    "MAP": ("map", "mean average precision", "mean ap", "average precision"),
    "IOU": ("iou", "intersection over union", "mean iou", "miou"),
    "FPS": ("fps", "frames per second", "frame rate", "inference fps"),
    "F1": ("f1", "f1 score", "f measure"),
    "PRECISION": ("precision", "prec"),
    "RECALL": ("recall", "rec"),
    "EXACT_MATCH": ("exact match", "em", "exact match score", "squad em"),
    "BLEU": ("bleu", "bleu score", "bleu4"),
    "ROUGE": ("rouge", "rouge score"),
    "ROUGE_L": ("rouge l", "rougel"),
    "METEOR": ("meteor", "meteor score"),
    "PERPLEXITY": ("perplexity", "ppl", "test perplexity", "validation perplexity"),
    "GLUE_SCORE": ("glue", "glue score", "average glue"),
    "SUPERGLUE_SCORE": ("superglue", "superglue score", "average superglue"),
    "WER": ("wer", "word error rate", "test wer"),
    "CER": ("cer", "character error rate"),
    "REWARD": ("reward", "average reward", "mean reward", "average return", "mean return", "episodic return", "episode reward", "cumulative reward"),
    "SUCCESS_RATE": ("success rate", "task success", "success percentage"),
    "MSE": ("mse", "mean squared error", "mean square error"),
    "RMSE": ("rmse", "root mean squared error", "root mean square error"),
    "MAE": ("mae", "mean absolute error"),
    "MAPE": ("mape", "mean absolute percentage error"),
    "R_SQUARED": ("r squared", "r2", "coefficient of determination"),
    "AUC": ("auc", "auroc", "roc auc", "area under roc"),
    "AUPRC": ("auprc", "pr auc", "area under pr"),
    "THROUGHPUT": ("throughput", "samples per second", "tokens per second", "images per second"),
    "LATENCY": ("latency", "inference latency", "inference time", "ms latency", "millisecond latency"),
    "MEMORY": ("memory", "memory usage", "peak memory", "gpu memory"),
    "TRAINING_TIME": ("training time", "train time", "time to train"),
    "CONVERGENCE_STEPS": ("convergence steps", "steps to convergence", "training steps"),
    "LOSS": ("loss", "training loss", "test loss", "validation loss"),
    "ERROR_RATE": ("error rate", "test error", "classification error"),
}
# fixed values: task of each data set (others: "other")
DATASET_TASKS = {
    "wmt": "translation", "glue": "classification", "superglue": "classification", "mnli": "classification", "cola": "classification", "sst-2": "classification", "sst 2": "classification",
    "mrpc": "classification", "qqp": "classification", "qnli": "classification", "rte": "classification", "wnli": "classification", "squad": "question_answering", "imagenet": "classification",
    "cifar-10": "classification", "cifar 10": "classification", "cifar-100": "classification", "cifar 100": "classification", "cnn": "summarization", "dailymail": "summarization",
    "xsum": "summarization", "samsum": "summarization", "penn treebank": "sequence_labeling", "ptb": "sequence_labeling", "conll": "sequence_labeling", "mmlu": "question_answering",
    "truthfulqa": "question_answering", "hellaswag": "classification", "arc": "classification", "winogrande": "classification", "gsm8k": "question_answering", "vtab": "classification",
    "ms-marco": "question_answering", "ms marco": "question_answering", "natural questions": "question_answering", "triviaqa": "question_answering", "hotpotqa": "question_answering",
}
# fixed values: metrics of which less is better (of all others more is)
LESS_IS_BETTER = ("wer", "cer", "latency", "perplexity", "loss", "error rate", "mse", "rmse", "mae", "fid")
# fixed values: verbs that a predicate should hold, words of compound claims, words of novelty
RELATION_VERBS = ("achieves", "outperforms", "demonstrates", "shows", "improves", "reduces", "increases", "maintains", "provides", "requires", "depends", "correlates")
CONJUNCTIONS = ("and", "or", "but", "however", "while", "whereas")
NOVELTY = ("new", "novel", "first", "unprecedented", "unexplored", "gap", "missing", "lacks")
# fixed values: words that name no cluster
LABEL_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might must can could of in to for with on at from by about as into "
    "through during before after above below between out off over under again further then once and but or nor not no so than too very that this these those it its we our they "
    "their which what who whom when where how all each every both few more most other some such only own same also just if using based results paper show propose method"
).split()
