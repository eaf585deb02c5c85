"""Enrichment of tables step by step, and analysis of the runs that did it, on Spark."""

from .config import EnrichmentConfig
from .errors import ConfigurationError, EnrichmentError, FieldValidationError, LLMAPIError, PipelineError, RowError, StepError
from .functions.logs import setup_logging
from .functions.web_search import web_search
from .hooks import EnrichmentHooks, PipelineEndEvent, PipelineStartEvent, RowAttemptEvent, RowCompleteEvent, StepEndEvent, StepStartEvent
from .operators.compare import ComparisonResult, compare
from .operators.report import Finding
from .operators.steps import ExprStep, FunctionStep, LLMStep, Step, StepContext, StepResult
from .pipeline import Enricher, Pipeline, PipelineResult
from .plans.preview import PipelinePlan, StepPlan
from .providers import BatchCapableLLMClient, EchoClient, LLMClient, ScriptedClient, is_batch_capable
from .sources.fields import FieldManager, load_fields
from .sources.runlog import JsonlRunLogger, read_prompt_ref
from .types import BatchRequest, BatchResult, CostSummary, FieldSpec, GroundingConfig, LLMResponse, StepUsage, UsageInfo

__version__ = "0.1.0"
__all__ = [n for n in dir() if n[0] != "_" and n[0].isupper()] + ["compare", "is_batch_capable", "load_fields", "read_prompt_ref", "setup_logging", "web_search"]
