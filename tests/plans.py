"""What Spark did for a query: the plans it ran, and the rows it shuffled."""


def ran(spark, run) -> list[str]:
    """The physical plans of all queries that run() starts."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    bus.waitUntilEmpty()
    before = max((e.executionId() for e in listed()), default=-1)
    run()
    bus.waitUntilEmpty()
    return [e.physicalPlanDescription() for e in listed() if e.executionId() > before]


def shuffled(spark, run) -> int:
    """The rows that run() shuffles."""
    sc, group = spark.sparkContext, f"shuffled-{id(run)}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
