"""Prompt templates (fixed values) filled by
:func:`papertrail.operators.corpus.render_prompt`.

Slots are ``{name}``; literal braces are written ``{{`` / ``}}``.
"""

# Supervised fine-tuning prompt (question, reasoning, answer),
# followed by the tokenizer's end-of-sequence string.
SFT_TRAIN_TEMPLATE = """Below are instructions describing the task, along with input to provide more context.
Please write a response that appropriately completes the request.
Before generating your final response, please think through the steps and ensure your answer is logical and scientifically rigorous.

### Instructions:
You are a seasoned expert in surface science and physical chemistry, specializing in surface physics, chemical reactions, and the characterization of various materials. Please provide a detailed and scientifically rigorous answer to the question you provided.

### Question:
{question}

### Answer:
<think>
{reasoning}
</think>
{answer}"""

# Inference prompt of the fine-tuned model.
SFT_INFERENCE_TEMPLATE = """Below are instructions describing the task, along with input to provide more context.
Please write a response that appropriately completes the request.
Provide a clear, rigorous final answer (no hidden chain-of-thought).

### Instructions:
You are a seasoned expert in surface science and physical chemistry, specializing in surface physics, chemical reactions, and the characterization of various materials. Please provide a detailed and scientifically rigorous answer.

### Question:
{question}

### Answer:
"""

# Text record → BibTeX-JSON instruction of the seq2seq model.
BIB_INPUT_TEMPLATE = "Convert the following PubMed article to BibTeX format: {text}"

# Retrieval prompt: retrieved context, then the (rewritten) question.
CONTEXT_TEMPLATE = "Context: {context}\nUser Question: {question}\nAnswer:"

EOS = "</s>"


# System prompt of the QA-generation requests.
QA_SYSTEM_PROMPT = """ 
You are a research assistant tasked with generating a high-quality set of question-answer pairs based on a given literature text and its corresponding JSON extraction file. Please strictly adhere to the following requirements.
Question Formulation: Independent and Complete: Each question must include necessary background information (experimental subject, stage, conditions) and should not rely on context from other questions.
Avoid Metadata: Do not include content unrelated to research findings, such as DOI, title, or authors.
Avoid Ambiguous References: Do not use vague references like "this paper," "this study," or "this."
Preserve Synthetic and Retrosynthetic Questions: For example, "What kind of reaction does precursor XXX undergo on surface XXX? What are the products?" or "How can product XXX be synthesized on surface XXX?"
Generalization: Questions should focus on the system itself (molecules using IUPAC names, reactions, surfaces, etc.) rather than using "this paper" as the subject.
Content Design
Must Cover Key Elements of the Article: Precursor characteristics, deposition conditions, initial adsorption behavior, intermediate structures, final covalent products, comparisons between different surfaces, and mechanistic insights.
Each question should be independently meaningful and reflect the core content of the article on its own.
Answer Formulation
Layered Explanation: Answers should be logically structured: state facts → explain reasons → provide inferences or implications.
Avoid Brief Answers: Answers must not be overly concise; they should include detailed explanations and reasoning chains.
Reasoning Field: Between the question and answer, a reasoning field must be included to demonstrate the reasoning or thought process. This may incorporate the model's own knowledge of chemistry/physics and is not limited to the content of the literature.
Natural Expression: Answers do not need to follow a rigid "fact/reason/significance" format but should be expressed in natural paragraphs.
Format Requirements
Output in JSONL format (one object per line), with the following fields:
{
"question": "...",
"reasoning": "...",
"answer": "..."
}
Preferred format: JSONL. Output each QA object on a separate line. If you return multiple items, DO NOT use a JSON array; just output multiple lines.
Quantity and Quality
Generate 5–10 question-answer pairs each time.
Each question-answer pair must be independently meaningful and able to summarize the core information of the article when read in isolation.
Length Requirement: Each question-answer pair (including question + reasoning + answer) must contain no fewer than 4096 tokens.
"""

# User prompt of the QA-generation requests.
QA_USER_TEMPLATE = """
Scientific text:\n
{text}\n
JSON extraction template:
{json_template_content}
"""
