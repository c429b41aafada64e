"""Topic learning by the method of moments, written as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from topicmoments.config import JobConfig, MomentOptions
from topicmoments.plans.fit import TopicModel, TopicMoments
from topicmoments.plans.job import run_job

# functions sent to tasks carry their code along, so that executors need not have this package
register_pickle_by_value(sys.modules[__name__])

__all__ = ["JobConfig", "MomentOptions", "TopicModel", "TopicMoments", "run_job"]
